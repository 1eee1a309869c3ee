"""Language identification by unigram piece models summed over all segmentations.

One fixed public vocabulary of pieces serves all languages; a language is a probability for each
piece. The score of a word is the sum over all its segmentations of the product of piece
probabilities, by a forward pass; a text scores the product of its words. Probabilities come from
expectation-maximisation over the word counts of a bounded sample of labelled rows, shrunk towards
those of all languages together. All languages and all words of a batch go through the forward
pass at once, as arrays.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import WORKER_CACHE, HashTable, mix, remainder, slices, without_clashes

#: Labelled rows per language that the model is fitted on; their whole texts are read.
SAMPLE_ROWS = 400
ROUNDS = 4
#: Weight, in pieces, of the shared distribution in a language's own one.
SHRINK = 200.0
MARK = "▁"
_WORDS = re.compile(r"[^\W\d_]+")
#: Signs that count as alphanumeric but are no letters, such as ½ and Ⅷ.
_NUMBERS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
MAX_LANGUAGES = 1_000
#: Words whose scores a worker remembers; beyond that it starts anew.
MEMO_WORDS = 800_000
#: Letters of a word, times languages, that go through a pass together.
CELLS = 800_000
#: Longer words are cut for fitting, never for scoring.
FIT_LETTERS = 1_000


def letter_runs(text: str) -> list[str]:
    """Runs of letters (category L) of a text in lower case."""
    words = _WORDS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for word in words for part in _NUMBERS.sub(" ", word).split()]


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece file that consist of letters and the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p and (p == MARK or p.removeprefix(MARK).isalpha()))


_UNIT = np.uint64(0x9E3779B97F4A7C15)


def _code_hash(codes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Hash of a piece from the hash of its prefix and one more code point."""
    start = np.uint64(0x51ED270B) if before is None else before
    return mix((start ^ codes.astype(np.uint64)) * _UNIT)


@dataclass
class PieceModel:
    """Sorted piece hashes and log probabilities (pieces x languages); row -1 is any other character."""

    languages: list[str]
    keys: np.ndarray
    logp: np.ndarray
    other: np.ndarray
    longest: int | None = None  # characters of the longest piece, if known

    def __post_init__(self):
        self.rows = HashTable(len(self.keys))
        self.rows.put(self.keys, np.arange(len(self.keys)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return self.rows.get(hashes)


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the marked words, padded with 0, and lengths."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le"), np.uint32)
    codes = np.zeros((len(words), int(lens.max())), np.uint32)
    codes[np.arange(codes.shape[1]) < lens[:, None]] = flat
    return codes, lens


def _spans(model: PieceModel, codes: np.ndarray, lens: np.ndarray):
    """(end, length, rows, piece) of every vocabulary piece in the words, by length."""
    width = codes.shape[1]
    hashes = None
    for length in range(1, min(model.longest or width, width) + 1):
        hashes = _code_hash(codes) if hashes is None else _code_hash(codes[:, length - 1 :], hashes[:, : width - length + 1])
        piece = model.find(hashes.ravel()).reshape(hashes.shape)
        inside = np.arange(width - length + 1) + length <= lens[:, None]
        yield length, np.where(inside, piece, -2)


def _alike(lengths: np.ndarray, languages: int) -> Iterator[np.ndarray]:
    """Words by length, in groups whose matrices stay small however long a word is."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        width = (lengths[order[at:]] + 2) * languages
        to = at + max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, "right")))
        yield order[at:to]
        at = to


def forward(model: PieceModel, words: list[str]) -> np.ndarray:
    """log sum over all segmentations, words x languages."""
    out = np.empty((len(words), len(model.languages)))
    for rows in _alike(np.fromiter(map(len, words), np.int64, len(words)), len(model.languages)):
        codes, lens = _matrix([words[i] for i in rows])
        out[rows] = _forward(model, codes, lens)[0]
    return out


def _forward(model: PieceModel, codes: np.ndarray, lens: np.ndarray, keep_all: bool = False):
    """Log forward sums at the end of each word; at every place only if asked for, else the last ones as far as a piece reaches."""
    n, width = codes.shape
    langs = len(model.languages)
    table = np.exp(np.vstack([model.logp, model.other[None], np.full((1, langs), -np.inf)]))
    none = len(table) - 1
    spans = {length: np.where(p == -2, none, np.where(p == -1, none - 1 if length == 1 else none, p)).astype(np.int32) for length, p in _spans(model, codes, lens)}
    sums = [np.zeros((n, langs))]
    last = np.zeros((n, langs))
    reach = max(spans)
    for end in range(1, width + 1):
        base = sums[-1]
        total = np.zeros((n, langs))
        for length, piece in spans.items():
            if length <= end:
                ids = piece[:, end - length]
                some = np.flatnonzero(ids != none)
                if len(some):
                    if length == 1:
                        total[some] += table[ids[some]]
                    else:
                        shift = np.exp(np.minimum(sums[-length][some] - base[some], 700.0))
                        total[some] += shift * table[ids[some]]
        sums.append(base + np.log(np.where(total > 0, total, 1.0)))
        done = lens == end
        last[done] = sums[-1][done]
        if not keep_all and len(sums) > reach:
            del sums[0]
    return last, sums, spans, table


def _expected(model: PieceModel, codes: np.ndarray, lens: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts x languages; weight: words x languages."""
    n, width = codes.shape
    last, sums, spans, table = _forward(model, codes, lens, keep_all=True)
    langs = len(model.languages)
    beta = np.full((width + 1, n, langs), -np.inf)
    beta[lens, np.arange(n)] = 0.0
    counts = np.zeros(table.shape)
    with np.errstate(divide="ignore"):
        logs = np.log(table)
    for start in range(width - 1, -1, -1):
        parts = [beta[start]]
        for length, piece in spans.items():
            if start + length <= width:
                ids = piece[:, start]
                some = np.flatnonzero(ids != len(table) - 1)
                if len(some):
                    value = np.full((n, langs), -np.inf)
                    value[some] = logs[ids[some]] + beta[start + length][some]
                    parts.append(value)
                    share = np.exp(np.minimum(sums[start][some] + value[some] - last[some], 0.0))
                    np.add.at(counts, ids[some], share * weight[some])
        top = parts[0]
        for value in parts[1:]:
            top = np.logaddexp(top, value)
        beta[start] = top
    return counts[:-1]


def _counts(rows: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, words and counts (words x languages) of the sample."""

    def task(batches):
        from collections import Counter

        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w[at : at + FIT_LETTERS]) for w in letter_runs(text) for at in range(0, len(w), FIT_LETTERS))
            yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    found = rows.mapInArrow(task, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    words = sorted(set(found.column("word").to_pylist()))
    at_lang, at_word = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(words)}
    counts = np.zeros((len(words), len(langs)))
    for lang, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[at_word[word], at_lang[lang]] += n
    return langs, words, counts


def sample_ids(docs: DataFrame, sample_rows: int, id_col: str, text_col: str, lang_col: str) -> list:
    """Of each label the `sample_rows` ids of least hash, with fewer ids all; more than MAX_LANGUAGES labels are an error.

    Labels are counted first. Then only the ids below a hash that lets a few more than wanted
    through are gathered, so that nothing that grows with the table meets in one task.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    known = known.withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(1 << 53)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    share = {lang: min(1.0, 1.2 * (sample_rows + 8 * sample_rows**0.5 + 50) / max(n, 1)) for lang, n in sizes.items()}
    chosen: dict = {}
    while share:
        below = F.create_map(*[F.lit(x) for lang, p in share.items() for x in (lang, int(p * (1 << 53)))])
        found: dict = {lang: [] for lang in share}
        for r in known.where(F.col("hash") <= below[F.col("lang")]).distinct().toLocalIterator():
            found[r["lang"]].append((r["hash"], r["id"]))
        for lang, rows in found.items():
            if len(rows) >= sample_rows or share[lang] >= 1.0:
                chosen[lang] = [i for _, i in sorted(rows)[:sample_rows]]
        share = {lang: min(1.0, 2 * p) for lang, p in share.items() if lang not in chosen}
    return sorted({i for ids in chosen.values() for i in ids})


def fit(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> PieceModel | None:
    """A model from at most `sample_rows` ids a language, those of the least hash.

    The ids are chosen from ids and labels alone, so texts that are not in the sample are never
    moved. Rows with a null id, text or label teach nothing; None if no labelled word is left. More
    than MAX_LANGUAGES labels are an error. Words of more than FIT_LETTERS letters are cut.
    """
    ids = sample_ids(docs, sample_rows, id_col, text_col, lang_col)
    if not ids:
        return None
    wanted = docs.sparkSession.createDataFrame(pa.table({"id": ids}))
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null").join(F.broadcast(wanted.distinct()), "id", "left_semi")
    langs, words, counts = _counts(texts.select("lang", "text"))
    if not words:
        return None
    pieces = vocabulary_pieces(vocabulary_path)
    keys = np.empty(len(pieces), np.uint64)
    for i, piece in enumerate(pieces):
        h = None
        for code in piece:
            h = _code_hash(np.array([ord(code)], np.uint32), h)
        keys[i] = h[0]
    keys = np.sort(keys)
    longest = max(map(len, pieces))
    start = np.full((len(keys), len(langs)), -np.log(len(keys) + 1.0))
    model = PieceModel(langs, keys, start, np.full(len(langs), -np.log(len(keys) + 1.0) - 2.0), longest)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for _ in range(rounds):
        total = np.zeros((len(keys) + 1, len(langs)))
        for rows in _alike(lengths, 4 * len(langs)):
            codes, lens = _matrix([words[i] for i in rows])
            total += _expected(model, codes, lens, counts[rows])
        shared = total.sum(axis=1, keepdims=True) + 0.05
        shared /= shared.sum()
        p = total + SHRINK * shared
        logs = np.log(p / p.sum(axis=0, keepdims=True))
        model = PieceModel(langs, keys, logs[:-1], logs[-1], longest)
    return model


def predict(docs: DataFrame, model: PieceModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the most probable language and its posterior with equal priors.

    `und` with score 0 if the text is null, empty or without letters, or if there is no model.
    Ties go to the language that sorts first. Every row gives one row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = ("langid", uuid.uuid4().hex)

    def task(batches):
        model = shared.value
        memo, scores = WORKER_CACHE.get(key) or ({}, np.zeros((0, 0 if model is None else len(model.languages))))
        for part in slices(batches, "text", cached=True):
            n = part.num_rows
            best, score = ["und"] * n, np.zeros(n)
            if model is not None:
                found = [letter_runs(t) if t else [] for t in part.column(1).to_pylist()]
                if len(memo) > MEMO_WORDS:
                    memo = {}
                new = list({w for words in found for w in words if w not in memo})
                if new:
                    made = forward(model, new)
                    at = len(memo)
                    if at + len(new) > len(scores):
                        scores = np.vstack([scores[:at], np.empty((len(new) + at // 2, made.shape[1]))])
                    scores[at : at + len(new)] = made
                    memo.update(zip(new, range(at, at + len(new)), strict=True))
                    WORKER_CACHE[key] = memo, scores
                sizes = np.fromiter(map(len, found), np.int64, n)
                flat = np.fromiter((memo[w] for words in found for w in words), np.int64, int(sizes.sum()))
                some = np.flatnonzero(sizes)
                if len(some):
                    total = np.add.reduceat(scores[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
                    top = total.argmax(axis=1)
                    score[some] = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, k in zip(some.tolist(), top.tolist(), strict=True):
                        best[i] = model.languages[k]
            yield pa.record_batch([part.column(0), pa.array(best, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = without_clashes(docs, id_col, text_col).toDF("id", "text").mapInArrow(task, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identify(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Fit on the rows whose crc32(doc_id) mod 4 is not 2, predict all: doc_id, held_out (false for a null id), lang_pred, score."""
    model = fit(docs.where(remainder(4) != 2), vocabulary_path)
    return predict(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
