"""Quality rules by document, and verdicts by host.

Each document gets counts and two base rules. A host's rate of failing documents is shrunk by a
beta prior that is fitted to the rates of all hosts, so a host with few documents stays close to
the corpus. A host whose shrunken rate is far above what is usual loses all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import Words, few, hidden, materialize, mix, segment_sums, slices, without_clashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes if this rate lies below the lower end of its shrunken rate.
HOST_RATE = 0.5
#: Standard deviations of the posterior that make up that lower end.
HOST_MARGIN = 2.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts (null: all 0)."""
    words = Words(column, lower=False)
    n, ptr = len(words.counts), words.ptr
    lead = (words.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead & words.inside)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
    hashes, owner = words.hashes(), words.owner()
    # words in 3-word windows that occur twice or more in the text
    repeat = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 2:
        at = np.flatnonzero(owner[:-2] == owner[2:])
        three = mix(mix(mix(hashes[at] + owner[at].astype(np.uint64)) ^ hashes[at + 1]) ^ hashes[at + 2])
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeat, at[twice], 1)
        np.add.at(repeat, at[twice] + 3, -1)
    covered = np.cumsum(repeat[:-1]) > 0
    # lines with a word, equal to an earlier line of the text
    dup = _dup_lines(words)
    return [words.counts, chars[words.off[1:]] - chars[words.off[:-1]], symbols[words.off[1:]] - symbols[words.off[:-1]], dup, segment_sums(covered, ptr) if len(hashes) else np.zeros(n, np.int64)]


def _dup_lines(words: Words) -> np.ndarray:
    data, off = words.data, words.off
    n = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    # a line ends at its line feed, or else with its text; two texts may share a start if one is empty
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], off[np.searchsorted(off, starts, "right")])
    word_at = np.concatenate([[0], np.cumsum(words.inside)])
    keep = word_at[stop] > word_at[starts]
    starts, stop = starts[keep], stop[keep]
    if not len(starts):
        return np.zeros(n, np.int64)
    from sparktab.llm.common import span_hashes

    owner = np.searchsorted(off, starts, "right") - 1
    key = mix(span_hashes(data, starts, stop) + owner.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    return np.bincount(owner[again], minlength=n)


def add_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the five counts and base_failed; columns of those names are replaced."""
    docs = docs.drop(*COUNTS, "base_failed")
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task(batches):
        for part in slices(batches, text_col):
            counts = text_counts(part.column(at))
            failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * counts[0])
            yield pa.record_batch([*part.columns, *[pa.array(c.astype(np.int64)) for c in counts], pa.array(failed)], names=[*part.schema.names, *COUNTS, "base_failed"])

    return docs.mapInArrow(task, f"{fields}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean")


def host_verdicts(rows: DataFrame, host_col: str, failed_col: str = "base_failed", rate: float = HOST_RATE, margin: float = HOST_MARGIN) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_rejected); a null host is a host of its own.

    The prior's mean and strength come from the moments of the hosts' rates, weighted by their
    documents. With one host, or rates that vary no more than chance, the prior is as strong as
    the corpus, and every host gets nearly the corpus's rate.
    """
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed_col).cast("long")).alias("host_failed"))
    hosts = materialize(hosts, "hosts")
    hosts = hosts.withColumn("p", F.col("host_failed") / F.col("host_docs"))
    n = F.sum("host_docs")
    sums = hosts.agg(n.alias("n"), (F.sum("host_failed") / n).alias("mean"), F.sum(F.col("host_docs") * F.col("p") * F.col("p")).alias("square"), F.count("*").alias("hosts"), (n - F.sum(F.col("host_docs") * F.col("host_docs")) / n).alias("spread"))
    found = sums.first()  # one row of sums
    mean, strength = 0.0, 0.0
    if found["n"]:
        # method of moments for the variance between hosts
        mean, n = found["mean"], float(found["n"])
        spread, within = found["spread"], mean * (1 - mean) * (found["hosts"] - 1)
        between = (found["square"] - n * mean * mean - within) / spread if spread > 0 else 0.0
        strength = min(max(mean * (1 - mean) / between - 1, 0.0), n) if between > 0 else n
    out = hosts.withColumn("mean", F.lit(mean)).withColumn("strength", F.lit(strength))
    a = F.col("host_failed") + F.col("mean") * F.col("strength")
    total = F.col("host_docs") + F.col("strength")
    out = out.withColumn("host_rate", a / total)
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (total + 1))
    return out.select("host", "host_docs", "host_failed", "host_rate", (F.col("host_rate") - margin * deviation > rate).alias("host_rejected"))


def _joined(rows: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """rows with host_rate and host_rejected. Many hosts are not broadcast: then a hot one is a skewed join of two written tables."""
    verdicts = verdicts.select(F.col("host").alias("of"), "host_rate", "host_rejected")
    verdicts = F.broadcast(verdicts) if few(verdicts, "of") else materialize(verdicts, "verdicts")
    return rows.join(verdicts, F.col(host).eqNullSafe(F.col("of")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row: id, host, the counts, base_failed, host_rate, kept.

    kept is false if base_failed, or if the host is rejected. A null or empty text has no words and
    fails. Repeated ids give repeated rows. An empty table gives an empty table. Only the three
    named columns are read.
    """
    rows = without_clashes(docs, id_col, text_col, host_col).toDF("id", "text", "host")
    made = materialize(add_counts(rows).drop("text"), "counts")
    out = _joined(made, host_verdicts(made, "host"), "host").drop("of")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without the rows that the base rules or their host's verdict reject.

    Each row has its own verdict, so a null or repeated id makes no difference. Columns are those of docs,
    whatever their names. An empty table gives an empty table.
    """
    names = docs.columns
    text, host = (f"c{names.index(c)}" for c in (text_col, host_col))
    rows = hidden(docs)
    made = materialize(add_counts(rows, text), "counted")
    kept = _joined(made.where("not base_failed"), host_verdicts(made, host), host).where("not host_rejected")
    return kept.select(rows.columns).toDF(*names)
