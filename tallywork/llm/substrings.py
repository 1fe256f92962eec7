"""Substring deduplication by level-wise doubling of repeated word windows.

Words are cut at white space and taken as they are. A window of `window` consecutive words of one document is a repeat if
the same words also start earlier: in a document of smaller doc_id (null is larger than any; rows of one doc_id follow one
another as they are stored), or further ahead in the same one. Each word that a repeat covers goes.

Levels: the first one looks at windows of `first` words. Of the first windows inside each window of twice that length only
the one of smallest hash is looked at, its anchor: equal windows have equal anchors, so about one position in six is sent.
Only windows whose anchor occurs more than once are extended to twice the length and counted; of those, windows both of
whose halves occur more than once are extended again; and so on to `window`, or until no candidate survives. Longer
windows than `window` remove no further words, so drop_repeats() stops there; longest_repeats() goes on to the end.

Documents are gathered into segments of about SEGMENT bytes, one stored row each, and each task works on whole segments. For
a level a segment sends each distinct hash once, with the place of its first occurrence, to the task that owns it; a text
with very many copies is one entry a segment. Owners answer with two bits an entry: does it occur elsewhere, and
earlier? Answers are stored in the shared folder by segment, where the segment's task reads them. So neither a group of
copies nor a frequent passage meets in one task, texts are written once and never shuffled, and a lost task is repeated
from stored segments and answers. Hashes have 64 bits; a second one chooses the owner, which adds its bits to the comparison.

Null and empty texts have no words; a text of fewer words than a window keeps them all; a text of any length is one segment's,
whole. Rows that repeat are copies like others: one of them stays. An empty table gives no rows. Only doc_id (an integer)
and text are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_view, materialize, parts, read_table, run_dir, writing

WINDOW, FIRST = 20, 10
#: Bytes of text in a segment, bytes hashed at a time, entries that one owner is meant for, segments whose answers share a file.
SEGMENT, CHUNK, OWNED, SHARED = 4_000_000, 1 << 20, 1 << 21, 16
U = np.uint64
#: Odd multipliers of the hashes: of bytes in a word, of words in a window (two hashes).
BYTE, WORD = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BYTE ** i and its inverse for i < 2 ** bits, modulo 2 ** 64."""
    n = 1 << bits
    return tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, b, U))]) for b in (BYTE, pow(BYTE, -1, 1 << 64)))


def word_spans(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in bytes."""
    inside = np.concatenate([[False], ~SPACE[body], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, worked out for about CHUNK bytes at a time."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK)))
        lo, hi = int(starts[a]), int(ends[b - 1])
        power, inverse = _powers(max(1, (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum((body[lo:hi].astype(U) + U(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * U(WORD[0]))
        a = b
    return out


class Segment:
    """The words of one stored segment and their windows."""

    def __init__(self, row, first: int):
        self.seg, self.body = row.seg, row.body
        self.ids, self.none, lengths = (np.frombuffer(x, t) for x, t in ((row.ids, "<i8"), (row.none, "u1"), (row.lengths, "<i8")))
        data = np.frombuffer(row.body, np.uint8)
        self.begins = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.begins + lengths
        starts, ends = word_spans(data)
        self.doc = np.searchsorted(self.begins, starts, side="right") - 1
        self.n = len(starts)
        w = word_hashes(data, starts, ends)
        self.first = first
        self.hashes = [self._of_words(w, m) for m in WORD]

    def _of_words(self, w: np.ndarray, m: int) -> np.ndarray:
        """A hash of the first-level window at each word; those that don't fit into the segment are never looked at."""
        n = max(0, self.n - self.first + 1)
        out = np.zeros(n, U)
        for j in range(self.first):
            out = out * U(m) + w[j : j + n]
        return mix(out)

    def doubled(self, length: int) -> None:
        """Go from hashes of windows of length to those of twice the length: each half's hash is known."""
        self.hashes = [mix(h[:-length] * U(m) + h[length:]) if len(h) > length else h[:0] for h, m in zip(self.hashes, WORD, strict=True)]

    def whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the starts at, those whose window of length lies in one document."""
        at = at[at + length <= self.n]
        return at[self.doc[at] == self.doc[at + length - 1]]

    def anchors(self, at: np.ndarray) -> np.ndarray:
        """For windows of twice the first length at the starts at, the place of the first-level window in them with the smallest hash."""
        h = self.hashes[0]
        best, place = h[at], at.copy()
        for j in range(1, self.first + 1):
            now = h[at + j]
            less = now < best
            best, place = np.where(less, now, best), np.where(less, at + j, place)
        return place


class Entries:
    """The distinct hashes at the places at, dealt to owners, each with its first place."""

    def __init__(self, part: Segment, at: np.ndarray, owners: int):
        self.part, self.at = part, at
        keys, first, self.of, counts = np.unique(part.hashes[0][at], return_index=True, return_inverse=True, return_counts=True)
        owner = (part.hashes[1][at[first]] % U(owners)).astype(np.int64)
        order = np.lexsort((first, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of = rank[self.of]
        self.keys, self.first, self.again, owner = keys[order], first[order], counts[order] > 1, owner[order]
        self.owners, cuts = np.unique(owner, return_index=True)
        self.cuts = np.append(cuts, len(owner))

    def messages(self, placed: bool):
        """(owner, seg, keys, again, ids, none) for each owner; the last two, where placed, say which document an entry starts in."""
        doc = self.part.doc[self.at[self.first]]
        ids, none = self.part.ids[doc], self.part.none[doc]
        for o, a, b in zip(self.owners, self.cuts[:-1], self.cuts[1:], strict=True):
            yield int(o), self.part.seg, self.keys[a:b].tobytes(), np.packbits(self.again[a:b]).tobytes(), ids[a:b].tobytes() if placed else b"", none[a:b].tobytes() if placed else b""

    def answered(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each place: whether its window occurs more than once, and whether it occurs earlier."""
        repeated, later = self.again.copy(), np.zeros(len(self.keys), bool)
        for o, a, b in zip(self.owners, self.cuts[:-1], self.cuts[1:], strict=True):
            bits = np.frombuffer(answers[int(o)], np.uint8).reshape(2, -1)
            repeated[a:b] |= np.unpackbits(bits[0], count=b - a).astype(bool)
            later[a:b] = np.unpackbits(bits[1], count=b - a).astype(bool)
        return repeated[self.of], later[self.of] | (self.first[self.of] != np.arange(len(self.at)))


def walk(part: Segment, lengths: list[int], owners: int, place: str, answers: bool) -> tuple[Entries, np.ndarray, np.ndarray] | Entries:
    """The candidates of the last of lengths; with answers, also what is known of them: repeated and later."""
    at = part.whole(np.arange(part.n), 2 * part.first)
    anchors = part.anchors(at)
    here = np.unique(anchors)
    for i, length in enumerate(lengths):
        if i:
            part.doubled(length // 2)
            here = at
        entries = Entries(part, here, owners)
        if length == lengths[-1] and not answers:
            return entries
        repeated, later = entries.answered(read_answers(f"{place}/{length}", part.seg) if len(here) else {})
        if length == lengths[-1]:
            return entries, repeated, later
        found = np.zeros(part.n + 1, bool)
        found[here[repeated]] = True
        if i:
            at = part.whole(here[repeated], 2 * length)
            at = at[found[at + length]]
        else:
            at = at[found[anchors]]
    raise ValueError("no lengths")


def segments(docs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row for about size bytes of text: seg, body (texts with a space between), lengths, ids, none, n_words; documents in order of doc_id."""
    def gathered(seg: int, held: list) -> pd.DataFrame:
        held.sort(key=lambda x: x[:2])
        texts = [x[2] for x in held]
        arrays = np.array([len(x) for x in texts], "<i8"), np.array([x[1] for x in held], "<i8"), np.array([x[0] for x in held], "u1")
        return pd.DataFrame({"seg": [seg], "body": [b" ".join(texts)], "lengths": [arrays[0].tobytes()], "ids": [arrays[1].tobytes()], "none": [arrays[2].tobytes()], "n_words": [sum(len(x.split()) for x in texts)]})

    def run(batches):
        seg, held, total = TaskContext.get().partitionId() << 32, [], 0
        for pdf in batches:
            for x in zip(pdf["none"], pdf["doc_id"], pdf["text"], strict=True):
                held.append(x)
                total += len(x[2]) + 1
                if total >= size:
                    yield gathered(seg, held)
                    seg, held, total = seg + 1, [], 0
        if held:
            yield gathered(seg, held)

    rows = docs.select(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(run, "seg long, body binary, lengths binary, ids binary, none binary, n_words long")


def decide(pdf: pd.DataFrame) -> np.ndarray:
    """Of the messages to one owner, (2, entries): which keys occur more than once, and which occur in an earlier document or segment."""
    sizes = np.array([len(x) // 8 for x in pdf["keys"]], np.int64)
    keys = np.frombuffer(b"".join(pdf["keys"]), U)
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf["again"], sizes, strict=True)])
    by = [np.repeat(pdf["seg"].to_numpy(), sizes)]
    if len(pdf["ids"].iloc[0]):
        by += [np.frombuffer(b"".join(pdf["ids"]), "<i8"), np.frombuffer(b"".join(pdf["none"]), "u1")]
    order = np.lexsort((*by, keys))
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    out = np.zeros((2, len(keys)), bool)
    out[0, order] = ~new | ~np.append(new[1:], True)
    out[0] |= again.astype(bool)
    out[1, order] = ~new
    return out


def own(messages: DataFrame, owners: int) -> DataFrame:
    """seg, owner, bits, n (entries that occur more than once) for each message."""
    def run(batches):
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        sizes = [len(x) // 8 for x in pdf["keys"]]
        bits, at, out = decide(pdf), 0, []
        for seg, owner, n in zip(pdf["seg"], pdf["owner"], sizes, strict=True):
            mine = bits[:, at : at + n]
            out.append((seg, owner, np.packbits(mine, axis=1).tobytes(), int(mine[0].sum())))
            at += n
        yield pd.DataFrame(out, columns=["seg", "owner", "bits", "n"])

    return messages.repartitionById(owners, "owner").mapInPandas(run, "seg long, owner int, bits binary, n long")


def answer_file(place: str, seg: int) -> str:
    return f"{place}/{seg // SHARED}.arrow"


def write_answers(answers: DataFrame, place: str) -> DataFrame:
    """A file for each SHARED neighbouring segments; returns file and n, what of their entries occurs more than once."""
    shape = pa.schema([("seg", pa.int64()), ("owner", pa.int32()), ("bits", pa.binary())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        file = answer_file(place, int(pdf["seg"].iloc[0]))
        with writing(file) as out, pa.ipc.new_file(out, shape) as w:
            w.write_table(pa.Table.from_pandas(pdf[["seg", "owner", "bits"]], shape, preserve_index=False))
        return pd.DataFrame({"file": [file], "n": [pdf["n"].sum()]})

    return answers.groupBy(F.expr(f"seg div {SHARED}").alias("at")).applyInPandas(run, "file string, n long")


def read_answers(place: str, seg: int) -> dict[int, bytes]:
    with pa.ipc.open_file(pa.py_buffer(local_view(answer_file(place, seg)))) as f:
        t = f.read_all()
    t = t.filter(pa.compute.equal(t["seg"], seg))
    return dict(zip(t["owner"].to_pylist(), t["bits"].to_pylist(), strict=True))


def count_level(segs: DataFrame, lengths: list[int], first: int, owners: int, place: str) -> int:
    """Count the candidates of the last of lengths; how many (of each segment's distinct ones) occur more than once."""
    placed = len(lengths) > 1

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                entries = walk(Segment(row, first), lengths, owners, place, answers=False)
                yield pd.DataFrame(list(entries.messages(placed)), columns=["owner", "seg", "keys", "again", "ids", "none"])

    sent = segs.select("seg", "body", "lengths", "ids", "none").mapInPandas(run, "owner int, seg long, keys binary, again binary, ids binary, none binary")
    return write_answers(own(sent, owners), f"{place}/{lengths[-1]}").agg(F.sum("n").alias("n")).first()["n"] or 0


def levels(docs: DataFrame, first: int, upto: int | None) -> tuple[DataFrame, list[int], int, str]:
    """(segments, lengths counted, owners, place of the answers): doubling from first to upto, or until no candidate survives."""
    spark = docs.sparkSession
    place = run_dir(spark, "substrings")
    segs = materialize(segments(docs), f"{place}/segments")
    words = segs.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    owners = max(parts(spark), -(-words // OWNED))
    lengths = [first]
    while count_level(segs, lengths, first, owners, place) and (upto is None or lengths[-1] < upto):
        lengths.append(2 * lengths[-1])
    return segs, lengths, owners, place


def drop_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay with a space between. window: first, doubled once or more."""
    if window < 2 * first or window % first or (window // first) & (window // first - 1):
        raise ValueError("window must be first, doubled once or more")
    segs, lengths, owners, place = levels(docs, first, window)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                part = Segment(row, first)
                gone = np.zeros(part.n + 1, np.int64)
                if lengths[-1] == window:  # else nothing of an earlier level occurs more than once
                    entries, _, later = walk(part, lengths, owners, place, answers=True)
                    at = entries.at[later]
                    gone[at] += 1
                    gone[at + window] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                counts = np.bincount(part.doc, minlength=len(part.ids))
                upto = np.cumsum(counts)
                removed, kept = np.zeros(len(part.ids), np.int64), []
                for i, (b, e, z, n) in enumerate(zip(part.begins, part.ends, upto, counts, strict=True)):
                    words, mine = part.body[b:e].split(), gone[z - n : z]
                    removed[i] = mine.sum()
                    if removed[i]:
                        words = [words[j] for j in np.flatnonzero(~mine)]
                    kept.append(b" ".join(words))
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(part.ids.copy(), part.none.astype(bool)), "n_words": counts, "n_removed": removed, "kept": kept})

    out = segs.select("seg", "body", "lengths", "ids", "none").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def longest_repeats(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """doc_id and longest: the greatest length, first doubled once or more, of a window of the document that occurs more than once anywhere (0: none)."""
    segs, lengths, owners, place = levels(docs, first, None)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                best = np.zeros(len(np.frombuffer(row.ids, "<i8")), np.int64)
                for k in range(2, len(lengths) + 1):
                    part = Segment(row, first)
                    entries, repeated, _ = walk(part, lengths[:k], owners, place, answers=True)
                    best[part.doc[entries.at[repeated]]] = lengths[k - 1]
                ids, none = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.none, "u1")
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), none.astype(bool)), "longest": best})

    return segs.select("seg", "body", "lengths", "ids", "none").mapInPandas(run, "doc_id long, longest long")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM split, unnest(range(1, len(w) - 18)) AS r(i)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM repeats, unnest(range(0, 20)) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(len(s.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""
