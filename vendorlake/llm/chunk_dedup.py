"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

The gear hash at a byte covers the last 16 bytes. A chunk ends where the hash is the least within REACH bytes on either
side, so an insertion moves only the boundaries near it, and chunks are REACH + 1 to about four times as long. Where
equal hashes lie closer, as in one word over and over, the first of them more than REACH after the last boundary counts,
so chunks there hold whole periods and are alike in every document; a chunk of LONGEST bytes is cut by length. Chunks whose digest
stands in two documents are kept; runs of three consecutive ones, known by all three digests, must stand together in
another document too, and such runs are joined into spans. A span thus is text that repeats, less up to a chunk at
either end of the repeated passage.

How much of a passage its span covers is a matter of bytes. With REACH at 10 chunks have 21 bytes on average, and of
passages of 51 words those missed are 1 in 400 if the words have 1 to 3 letters (109 in 400 with REACH at 16), 12 if they
have 1 or 2 (232), none if they have 2 to 8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written
from .shipping import ship
from .wordhash import SPACED, Words, _powers, mix, pieces

REACH = 10
LONGEST = 1024
#: A digest with more than 1 in HOT of the rows is hot.
HOT = 4096
_CHUNKS = "id long, text_key long, digest long, place long"


def _gear() -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()
with np.errstate(over="ignore"):
    _CODE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 2) + GEAR[byte] modulo 2**32 at every byte of one text, by doubling the window."""
    with np.errstate(over="ignore"):
        h = GEAR[data]
        for k in (1, 2, 4, 8):
            h[k:] = h[k:] + (h[:-k] << np.uint32(2 * k))
    return h


def _least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """The least of the reach values before each place; the largest number where there is none."""
    out = np.full(len(h), np.iinfo(h.dtype).max, h.dtype)
    out[1:] = h[:-1]
    done = 1
    while done < reach:
        step = min(done, reach - done)
        out[step:] = np.minimum(out[step:], out[:-step].copy())
        done += step
    return out


def boundaries(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of one text, the last one included; empty for an empty text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = rolling(data)
    cut = (h <= _least_before(h, REACH)) & (h <= _least_before(h[::-1], REACH)[::-1])
    cut[: REACH] = False
    cut[n - REACH - 1 :] = False
    ends = np.flatnonzero(cut) + 1
    if len(ends) and np.diff(ends).min(initial=REACH + 1) <= REACH:  # equal hashes, as where a word repeats
        kept, last = [], -1 - REACH
        for e in ends.tolist():
            if e - last > REACH:
                kept.append(e)
                last = e
        ends = np.array(kept)
    ends = np.append(ends, n)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(wide):
        starts = np.concatenate([[0], ends[:-1]])
        ends = np.unique(np.concatenate([ends, *(np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in wide)]))
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, size=1 << 20):
        text = Words(batch.column("text"), SPACED)
        bounds = text.bounds.tolist()
        ends = [boundaries(text.data[a:b]) + a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        each = np.array([len(e) for e in ends], np.int64)
        stop = np.concatenate(ends).astype(np.int64) if ends else np.zeros(0, np.int64)
        first = np.cumsum(each) - each
        at = np.arange(len(stop)) - np.repeat(first, each)  # 0 at a text's first chunk
        base = np.repeat(text.bounds[:-1], each)
        start = np.where(at == 0, base, np.concatenate([[0], stop[:-1]]) if len(stop) else stop)
        words = np.searchsorted(text.start, stop) - np.searchsorted(text.start, start)
        power, inverse = _powers(len(text.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(text.data) + 1, np.uint64)
            np.cumsum(_CODE[text.data] * power[:-1], out=total[1:])
            digest = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)).astype(np.int64)
        ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), each)))
        place = (start - base) << 24 | (stop - start) << 12 | words
        keys = batch.column("text_key").take(pa.array(np.repeat(np.arange(batch.num_rows), each)))
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(digest), pa.array(place)], ["id", "text_key", "digest", "place"])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of every text: id, text_key (a hash of the text), digest (64 bits), place (start << 24 | length << 12 | words: its first byte, its bytes, and the words that begin in it)."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.withColumn("text_key", F.xxhash64("text")).mapInArrow(_chunks, _CHUNKS)


def spread(chunked: DataFrame) -> DataFrame:
    """chunks() with start, stop and words for place."""
    start, length = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(4095)
    return chunked.withColumns({"start": start, "stop": start + length, "words": F.col("place").bitwiseAND(4095)}).drop("place")


def _in_two(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key stands in two documents, with first_id, the smallest of these, and salt, which follows from the
    key, id and place or start.

    Counts are pre-aggregated, and the keys met are a table of their own. A key that holds more than 1 in HOT of its rows
    is dealt into parts of about that many, by salt; such keys are fewer than HOT, and so is what they add to the table.
    """
    met = df.groupBy(*keys).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")).where("first_id < last_id").drop("last_id")
    met = written(met, "met")
    fair = (met.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    hot = met.where(F.col("n") > fair).select(*keys, F.ceil(F.col("n") / fair).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("id", "place" if "place" in df.columns else "start"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = df.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).drop("parts")
    parts = F.when(F.col("n") > fair, F.ceil(F.col("n") / fair).cast("int")).otherwise(1)
    copies = met.select(*keys, "first_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    return dealt.join(copies.hint("merge"), [*keys, "salt"])


def span_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """Spans of text that stand in other documents too, a row each: id, text_key, start, stop (bytes of UTF-8), words, and
    keeper (the smallest document that holds a part of it, whose copy stays).

    A span is kept if at least min_words words begin in it; as about 7 long or 15 short words at the ends of a repeated
    passage lie outside its span, 20 finds passages of over 50 words. Null and empty texts have no chunk and no row. A null id takes
    no part. Rows that repeat an id are one document; a text repeated under its id counts once. Other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = _in_two(chunks(docs, id_col, text_col).where("id is not null"), ["digest"]).drop("first_id").distinct()
    shared = written(spread(shared.drop("salt")), "shared")
    w = W.partitionBy("id", "text_key").orderBy("start")
    after = lambda c, n: F.lead(c, n).over(w)
    run = shared.withColumns(
        {
            "joined": (after("start", 1) == F.col("stop")) & (after("start", 2) == after("stop", 1)),
            "stop3": after("stop", 2),
            "t1": F.xxhash64("digest", after("digest", 1), after("digest", 2)),
            "t2": F.xxhash64(after("digest", 2), after("digest", 1), "digest"),
            "words3": F.col("words") + after("words", 1) + after("words", 2),
        }
    ).where("joined")
    whole = _in_two(run.select("id", "text_key", "start", "stop3", "words", "words3", "t1", "t2"), ["t1", "t2"])
    by = W.partitionBy("id", "text_key").orderBy("start")
    reached = F.max("stop3").over(by.rowsBetween(W.unboundedPreceding, -1))
    numbered = whole.withColumn("fresh", F.when(F.col("start") < reached, 0).otherwise(1)).withColumn("span", F.sum("fresh").over(by))
    # Overlapping runs of three: each adds its first chunk's words, the last of the span those of all three.
    return numbered.groupBy("id", "text_key", "span").agg(
        F.min("start").alias("start"), F.max("stop3").alias("stop"), F.min("first_id").alias("keeper"),
        (F.sum("words") + F.max_by(F.col("words3") - F.col("words"), "start")).alias("words"),
    ).where(F.col("words") >= min_words).drop("span")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """The spans of span_rows(), one row per document that has any: id_col, n_spans (long), n_bytes (long, in all spans),
    n_words (long), first_id (the smallest document that holds one of its spans), spans (string: start:stop in bytes of
    UTF-8, comma-joined in order), keepers (string: the documents whose copies of these spans stay, comma-joined alike).
    The spans of several texts under one id are listed together.
    """
    listed = F.sort_array(F.collect_list(F.struct("start", "stop", "keeper")))
    found = span_rows(docs, id_col, text_col, min_words).groupBy("id").agg(
        F.count("*").alias("n_spans"), F.sum(F.col("stop") - F.col("start")).alias("n_bytes"), F.sum("words").alias("n_words"), F.min("keeper").alias("first_id"), listed.alias("l"),
    )
    return found.select(
        F.col("id").alias(id_col), "n_spans", "n_bytes", "n_words", "first_id",
        F.array_join(F.transform("l", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("spans"), F.array_join(F.transform("l", lambda s: s["keeper"]), ",").alias("keepers"),
    )


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """The text without these spans (bytes of UTF-8, in order); a character that a span cuts in two stays."""
    data, out, at = (text or "").encode(), [], 0
    inside = lambda i: i < len(data) and 0x80 <= data[i] < 0xC0
    for start, stop in spans:
        while inside(start):
            start += 1
        while inside(stop):
            stop -= 1
        if stop > start:
            out.append(data[at:start])
            at = stop
    return b"".join([*out, data[at:]]).decode()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """One row per row of docs: id_col and kept_text (string: the text without the spans that a document of a smaller id
    keeps). Null texts give empty ones; null ids keep their texts; repeated rows come out as often as they came in.
    """
    spans = span_rows(docs, id_col, text_col, min_words).where("keeper < id")
    spans = spans.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("l"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept = [without_spans(t, [(s["start"], s["stop"]) for s in x or ()]) for t, x in zip(batch.column("text").to_pylist(), batch.column("l").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.string())], ["id", "kept_text"])

    return d.join(spans, ["id", "text_key"], "left").select("id", "text", "l").mapInArrow(cut, "id long, kept_text string").withColumnRenamed("id", id_col)
