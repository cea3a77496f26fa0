"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes; where its high bits are all zero a chunk ends, so cuts
follow content and an insertion moves only the cuts beside it.  Chunks are keyed by a 96-bit digest
(10**12 chunks have a collision with a probability of 1e-5).
Each digest's first place (smallest doc_id, then position) stays, all later ones are repeats.  Runs of
repeated chunks are extended, character by character, on either side to what they share with any other place
of the chunk at their end: the texts beside all places of such a chunk are put in order, where the longest match
of each is one of its neighbours.  Extended runs of at least ``MIN_WORDS`` whole words are a text's repeated passages.

The rolling hash has a window of 32 bytes: the sum of 32 shifted table entries, which five doubling
steps give for a whole text at once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import OWN, PART, with_halo
from ..session import send_package
from .common import SLICE_BYTES, _arrow_schema, arrow_batch, checkpoint_dir, cut, delete_folder, list_fields, lists_of, map_slices, stored, texts_of, utf8_of

#: One byte in 2**MASK_BITS qualifies for a cut; a chunk has at least and at most so many bytes (about 40 on average).
MASK_BITS, MIN_BYTES, MAX_BYTES = 4, 16, 96
#: Whole words of a passage at least, and characters that a run is extended by on a side at most: a passage
#: that goes on for longer holds a chunk, and so a part of the run, there.
MIN_WORDS, EDGE = 40, 512
#: Different texts beside one chunk that a task puts in order.
NEIGHBOURS = 1 << 16
#: Rows of texts that are decoded once and kept; of more, a group with very many texts, each stretch is decoded twice.
DECODED = 20_000
NULL_ID = -(1 << 63)
#: doc_ids with several texts that are broadcast at most.
LISTED = 100_000
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=77) for b in range(256)], dtype=np.uint32)


#: Whether a code point is white space; the last entry stands for all later ones.
SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 32 bytes that end there, along the last axis."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[..., shift:] += h[..., :-shift] << np.uint32(shift)
    return h


def _hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The gear hash at each byte of texts that stand one after another, each from its own bytes alone."""
    h = gear_hash(raw)
    heads = starts[:, None] + np.arange(31)
    own = heads < stops[:, None]
    h[heads[own]] = gear_hash(raw[np.minimum(heads, len(raw) - 1)])[own]
    return h


def chunk_ends(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Ends of the chunks in the bytes of texts one after another, each at the end of a code point; the last of a text is its end.

    A place qualifies by its hash alone, and cuts if none qualified in the ``MIN_BYTES`` before it: both
    depend on nearby bytes only, so two texts cut alike as soon as they share so many.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    hashes = _hashes(raw, starts, stops)
    border = lambda ends: (raw[np.minimum(ends, len(raw) - 1)] & 0xC0 != 0x80) | (ends == len(raw))
    places = np.flatnonzero(hashes < np.uint32(1 << (32 - MASK_BITS))) + 1  # the high bits depend on all 32 bytes
    places = places[border(places)]
    before = np.maximum(np.append(0, places[:-1]), starts[np.searchsorted(stops, places)])
    ends = np.union1d(places[places - before >= MIN_BYTES], stops[stops > starts])
    last = np.append(0, ends[:-1])
    found = [ends]
    long = ends - last > MAX_BYTES
    ends, last = ends[long], last[long]
    back = np.arange(MAX_BYTES, MIN_BYTES - 1, -1)
    while len(ends):  # as in a text of one repeated word: the last of the smallest hashes, so that cuts follow content here too
        window = last[:, None] + back
        ranked = np.where(border(window), hashes[window - 1], np.uint32(0xFFFFFFFF))
        last = last + MAX_BYTES - ranked.argmin(axis=1)
        found.append(last)
        long = ends - last > MAX_BYTES
        ends, last = ends[long], last[long]
    return np.sort(np.concatenate(found))


def _chunks(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of the text, 64 and 32 bits of a digest, start, end, and whether it is the last, of each chunk of texts one after another.

    Places in code points of the text, end exclusive.
    """
    starts, stops, data = bounds[:-1], bounds[1:], raw.tobytes()
    ends = chunk_ends(raw, starts, stops)
    begins = np.append(0, ends[:-1])[: len(ends)]
    digests = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())])
    hi = (np.frombuffer(digests, ">u8")[::2].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    lo = (np.frombuffer(digests, ">u4")[3::4].astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)
    text = np.searchsorted(stops, ends)
    last = stops[text] == ends
    if len(raw) and raw.max() > 0x7F:
        sizes = np.add.reduceat(raw & 0xC0 != 0x80, begins, dtype=np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
    base = begins[np.searchsorted(text, text)]
    return text, hi, lo, begins - base, ends - base, last


def chunks_of(text: str) -> list[tuple[int, int, int, int]]:
    """(64 and 32 bits of a digest, start, end) of each chunk; places in code points, end exclusive."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return list(zip(*(c.tolist() for c in _chunks(raw, np.array([0, len(raw)]))[1:5])))


CHUNKS = "doc_id long, tid long, at int, hi long, lo int, size int"
PLACE = ("doc_id", "tid", "at")


def chunk_table(texts: DataFrame) -> DataFrame:
    """doc_id, tid, at, hi, lo, size: every chunk of every text (doc_id, tid, text); the size of a text's last chunk is negative."""

    def work(part: pa.RecordBatch) -> Iterator[list]:
        text, hi, lo, start, end, last = _chunks(*utf8_of(part.column("text")))
        size = np.where(last, start - end, end - start)
        yield [part.column("doc_id").to_numpy()[text], part.column("tid").to_numpy()[text], start.astype(np.int32), hi, lo, size.astype(np.int32)]

    return map_slices(texts.select("doc_id", "tid", "text"), work, CHUNKS, 512, SLICE_BYTES // 16)


RUNS = "runs array<struct<start: int, end: int, chunks: int, left_hi: long, left_lo: int, right_hi: long, right_lo: int, last: boolean>>"
LATER = "later array<struct<run: int, start: int, end: int, chunks: int>>, firsts array<struct<run: int, doc: long>>"


def _runs(gathered: DataFrame) -> DataFrame:
    """doc_id, tid, runs, later, firsts from each text's repeated chunks in order: a run's chunks adjoin.

    ``left`` and ``right`` are the digests at a run's ends; ``last``: the text ends there.  ``later``: parts of runs whose chunks
    have their first place elsewhere, ``firsts``: the documents of those places.
    """
    schema = f"doc_id long, tid long, {RUNS}, {LATER}"
    kinds = {f.name: f.type for f in _arrow_schema(gathered.sparkSession, schema)}

    def work(part: pa.RecordBatch) -> Iterator[list]:
        counts, c = list_fields(part.column("chunks"))
        rows, n = len(counts), len(c["at"])
        text = np.repeat(np.arange(rows), counts)
        end = c["at"] + np.abs(c["size"])
        new, beside = np.ones(n, bool), np.ones(n, bool)
        beside[1:] = (text[1:] == text[:-1]) & (end[:-1] == c["at"][1:])
        new[1:] = ~beside[1:]
        run = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        tail = np.append(head[1:], n)[: len(head)] - 1
        of_text = text[head]
        within = np.arange(len(head)) - np.searchsorted(of_text, of_text)  # a run's number in its text
        runs = lists_of(np.bincount(of_text, minlength=rows), [c["at"][head], end[tail], tail - head + 1, c["hi"][head], c["lo"][head], c["hi"][tail], c["lo"][tail], c["size"][tail] < 0], kinds["runs"])
        later = c["later"]
        opens = later & (new | ~np.append(False, later[:-1])[:n])
        closes = later & (np.append(new[1:], True)[:n] | ~np.append(later[1:], False)[:n])
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        parts = lists_of(np.bincount(text[a], minlength=rows), [within[run[a]], c["at"][a], end[b], b - a + 1], kinds["later"])
        of_run, doc = run[later], c["first_doc"][later]
        order = np.lexsort((doc, of_run))
        of_run, doc = of_run[order], doc[order]
        once = np.append(True, (of_run[1:] != of_run[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
        of_run, doc = of_run[once], doc[once]
        firsts = lists_of(np.bincount(of_text[of_run], minlength=rows), [within[of_run], doc], kinds["firsts"])
        yield [part.column("doc_id"), part.column("tid"), runs, parts, firsts]

    return map_slices(gathered, work, schema, 1024)


def _words(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts one after another: whether each code point is no white space, and how many words begin before it (and before the end)."""
    solid = _solid(codes)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[starts] = solid[starts]
    return solid, np.append(np.int32(0), np.cumsum(begins, dtype=np.int32))


def _solid(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is no white space; some at a time, since looking them up takes more room than they do."""
    out = np.empty(len(codes), bool)
    for at in range(0, len(codes), 1 << 20):
        out[at : at + (1 << 20)] = ~SPACES[np.minimum(codes[at : at + (1 << 20)], len(SPACES) - 1)]
    return out


def _decoded(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts of a column one after another, their code points, and the ends of the texts behind a 0."""
    text = utf8_of(column)[0].tobytes().decode()
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), np.append(0, np.cumsum(pc.utf8_length(column).to_numpy(), dtype=np.int64))


MEASURED = "runs array<struct<start: int, end: int, chunks: int, words: int>>, later array<struct<run: int, start: int, end: int, chunks: int, words: int, over: int>>, firsts array<struct<run: int, doc: long>>"
EDGES = "run int, side int, hi long, lo int, at int, solid boolean, beside string"


def _beside(found: DataFrame) -> DataFrame:
    """doc_id, tid, and either runs, later and firsts, or an edge, from each text with its runs and the places asked of it.

    Runs and their later parts get the number of words that begin in them; a later part also whether a word goes on
    over its end.  An edge is a place's text on one side, away from it, up to one character more than is compared.
    ``solid``: the character on the other side is no white space; ``run``: the run whose end this is, or -1.
    """
    schema = f"doc_id long, tid long, {MEASURED}, {EDGES}"
    kinds = {f.name: f.type for f in _arrow_schema(found.sparkSession, schema)}

    def work(part: pa.RecordBatch) -> Iterator[list]:
        text, codes, base = _decoded(part.column("text"))
        solid, words = _words(codes, base[:-1])
        (n_runs, r), (n_later, p), (n_asked, q) = (list_fields(part.column(c)) for c in ("runs", "later", "asked"))
        rows = np.arange(part.num_rows)
        of_run, of_later, of_asked = (np.repeat(rows, n) for n in (n_runs, n_later, n_asked))
        a, b = base[of_run] + r["start"], base[of_run] + r["end"]
        runs = lists_of(n_runs, [r["start"], r["end"], r["chunks"], words[b] - words[a]], kinds["runs"])
        a, b = base[of_later] + p["start"], base[of_later] + p["end"]
        inside = np.minimum(b, len(text) - 1)
        over = (b < base[of_later + 1]) & solid[b - 1] & solid[inside]
        later = lists_of(n_later, [p["run"], p["start"], p["end"], p["chunks"], words[b] - words[a], over.astype(np.int32)], kinds["later"])
        yield [part.column("doc_id"), part.column("tid"), runs, later, part.column("firsts"), *[None] * 7]

        place = lambda row, at, side: row << 32 | at.astype(np.int64) << 1 | side
        ends = np.concatenate((place(of_run, r["start"], 0), place(of_run, r["end"], 1)))
        order = np.argsort(ends)
        asked = place(of_asked, q["at"], q["side"].astype(np.int64))
        near = order[np.minimum(np.searchsorted(ends, asked, sorter=order), len(ends) - 1)]
        first = np.cumsum(n_runs) - n_runs
        number = np.tile(np.arange(len(of_run)) - first[of_run], 2)
        run = np.where(ends[near] == asked, number[near], -1)
        low, high = base[of_asked], base[of_asked + 1]
        at, left = low + q["at"], q["side"] == 0
        a, b = np.where(left, np.maximum(low, at - EDGE - 1), at), np.where(left, at, np.minimum(high, at + EDGE + 1))
        beside = [text[x:y][::-1] if back else text[x:y] for x, y, back in zip(a.tolist(), b.tolist(), left.tolist())]
        ids = (part.column(c).to_numpy()[of_asked] for c in ("doc_id", "tid"))
        yield [*ids, None, None, None, run, q["side"], q["hi"], q["lo"], q["at"], solid[np.where(left, at, at - 1)], beside]

    return map_slices(found.select("doc_id", "tid", "runs", "later", "firsts", "asked", "text"), work, schema, 512, SLICE_BYTES // 4)


ENDS = "first_doc_id long, first_tid long, first_at int, n int, words int, over int, first_n int, first_words int, first_over int, alone_over int"


def _longest_matches(edges: DataFrame, folder: str) -> DataFrame:
    """hi, lo, side, key (of ``beside``) and ``ENDS``: for each text beside a chunk what it shares.

    ``n``: characters at most that it shares with the text beside another place of the chunk, the words that begin in
    them and whether a word goes on beyond, and the same for what it shares with the text beside the first place of (hi, lo, side);
    ``alone_over``: the last for no characters.  Equal texts are one row; of others the longest match is next to it in order.
    A key's texts move once to be put in order, and what leaves is numbers.
    """
    digest = F.struct("hi", "lo", "side").alias("digest")
    place = F.struct(*PLACE)
    # ``solid`` is the same at all places of a chunk
    beside = stored(edges.groupBy(digest, "beside").agg(F.min(place).alias("lowest"), F.max(place).alias("highest"), F.min("solid").alias("solid")), folder)
    lined = with_halo(beside, "digest", ["beside"], 1, NEIGHBOURS)
    firsts = lined.filter(F.col(PART) > 0).groupBy("digest").agg(F.min_by("beside", "lowest").alias("first_beside"), F.min("lowest").alias("first"))
    ranges = lined.filter(F.col(PART) > 0).join(firsts, "digest").select(*lined.columns, "first_beside", "first")
    both = lined.filter(F.col(PART) == 0).withColumns({"first_beside": F.lit(None).cast("string"), "first": F.col("lowest")}).unionByName(ranges)
    flat = both.select("digest.*", PART, OWN, "solid", (F.col("lowest") == F.col("highest")).alias("single"), *(F.col(f"first.{c}").alias(f"first_{c}") for c in PLACE), "first_beside", "beside")
    group = ["hi", "lo", "side", PART]
    ordered = flat.repartition(*group).sortWithinPartitions(*group, "beside").withColumn("key", _key("beside"))
    schema = f"hi long, lo int, side int, key binary, {ENDS}"
    send_package(edges.sparkSession)
    types = _arrow_schema(edges.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole_groups(batches, group):
            columns = _shared_ends(groups)
            if len(columns[0]):
                yield arrow_batch(columns, types)

    return ordered.mapInArrow(run, schema)


def _changes(rows: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before it in any of the columns."""
    values = [rows.column(c).to_numpy() for c in columns]
    return np.any([v[1:] != v[:-1] for v in values], axis=0)


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Rows in order, cut between groups of equal columns only; a group has about ``NEIGHBOURS`` rows at most."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and _changes(pa.Table.from_batches([kept[-1].slice(kept[-1].num_rows - 1), batch.slice(0, 1)]), columns)[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        cuts = np.flatnonzero(_changes(batch, columns)) + 1
        if len(cuts):
            yield pa.Table.from_batches([*kept, batch.slice(0, int(cuts[-1]))])
            kept = [batch.slice(int(cuts[-1]))]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _lcp(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Code points, up to ``most``, that what begins at ``a`` and at ``b`` shares."""
    n, done, step = np.zeros(len(a), np.int64), 0, 16
    rest = np.flatnonzero(most > 0)
    while len(rest):
        along = done + np.arange(step)
        i, j = (np.minimum(x[rest][:, None] + along, len(codes) - 1) for x in (a, b))
        same = codes[i] == codes[j]
        whole = same.all(axis=1)
        n[rest] = np.minimum(done + np.where(whole, step, same.argmin(axis=1)), most[rest])
        done += step
        rest = rest[whole & (most[rest] > done)]
        step = 64
    return n


def _least_since(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The least of the values (0 to ``EDGE``) behind the last mark, up to each."""
    marked = np.zeros(len(values), np.int64)
    marked[marks] = 1
    lowered = 2 * EDGE * np.cumsum(marked)  # so that what stands before a mark is never the least
    return np.minimum.accumulate(np.where(marked, EDGE, values) - lowered) + lowered


def _stretches(table: pa.Table, size: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, code points of ``beside`` one after another, where each begins, and its length, some rows at a time: the last row
    of a stretch is the first of the next."""
    column = table.column("beside")
    for at in range(0, max(1, table.num_rows - 1), size):
        _, codes, base = _decoded(column.slice(at, size + 1).combine_chunks())
        yield at, codes, base[:-1], np.diff(base)


def _shared_ends(table: pa.Table) -> list:
    """The columns of ``_longest_matches`` from whole groups of texts in order."""
    rows, c = table.num_rows, {n: table.column(n).to_numpy() for n in ("hi", "lo", "side", PART, OWN, "solid", "single", *(f"first_{p}" for p in PLACE))}
    new = np.append(True, _changes(table, ["hi", "lo", "side", PART]))
    group = np.cumsum(new) - 1
    several = rows <= DECODED and list(_stretches(table))
    before, most = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for at, codes, base, length in several or _stretches(table):
        most[at : at + len(base)] = np.minimum(length, EDGE)
        i = np.flatnonzero(~new[at + 1 : at + len(base)])
        before[at + 1 + i] = _lcp(codes, base[i + 1], base[i], np.minimum(most[at + 1 + i], most[at + i]))
    after = np.append(before[1:], 0)
    shared = np.where(c["single"], np.maximum(before, after), most)

    # what a text shares with the first place's is the least of what neighbours share on the way there
    order = np.lexsort((c["first_at"], c["first_tid"], c["first_doc_id"], group))
    firsts = order[new]  # groups have their rows at the same numbers in both orders
    first = firsts[group]
    number = np.arange(rows)
    with_first = np.where(number == first, most, np.where(number > first, _least_since(before, firsts), _least_since(after[::-1], rows - 1 - firsts)[::-1]))
    places = [c[f"first_{p}"][first] for p in PLACE]
    hot = np.flatnonzero(c[PART] > 0)
    if len(hot):  # a range of a key has its first place elsewhere
        for k, name in enumerate(PLACE):
            places[k] = np.where(c[PART] > 0, c[f"first_{name}"], places[k])
        texts, theirs = (table.column(n).take(hot).to_pylist() for n in ("beside", "first_beside"))
        with_first[hot] = [min(EDGE, len(os.path.commonprefix((x, y)))) for x, y in zip(texts, theirs)]

    side, counted = c["side"], {k: np.zeros(rows, np.int32) for k in ("words", "over", "first_words", "first_over", "alone_over")}
    for at, codes, base, length in several or _stretches(table):
        span = slice(at, at + len(base))
        solid = _solid(codes)
        # away from a run's beginning, a word begins where white space or nothing follows; away from its end, where white space precedes
        onto, back = np.append(solid[1:], False), np.append(False, solid[:-1])
        back[base], onto[base + length - 1] = c["solid"][span], False
        left = np.repeat(side[span] == 0, length)
        begins = np.append(0, np.cumsum(solid & ~np.where(left, onto, back)))
        goes_on = np.append(solid & back, False)  # over the place before a character
        for n, words, over in ((shared, "words", "over"), (with_first, "first_words", "first_over"), (np.zeros(rows, np.int64), None, "alone_over")):
            to = base + n[span]
            if words:
                counted[words][span] = begins[to] - begins[base]
            counted[over][span] = (side[span] == 1) & (n[span] < length) & goes_on[to]
    own = c[OWN]
    numbers = [*places, shared, counted["words"], counted["over"], with_first, counted["first_words"], counted["first_over"], counted["alone_over"]]
    return [c["hi"][own], c["lo"][own], side[own], table.column("key").combine_chunks().filter(pa.array(own)), *(x[own] for x in numbers)]


def _key(text: str):
    return F.unhex(F.md5(text))


def _extensions(edges: DataFrame, folder: str) -> DataFrame:
    """doc_id, tid, ends: for each end of a run the characters by which it is extended, the words that begin in
    them and whether a word goes on beyond, of the run and of its later part."""
    matches = _longest_matches(edges, folder)
    own = edges.filter("run >= 0").select("doc_id", "tid", "at", "run", "hi", "lo", "side", _key("beside").alias("key"))
    itself = F.struct(*PLACE) == F.struct(*(F.col(f"first_{c}") for c in PLACE))
    end = [F.col(c) for c in ("run", "side", "n", "words", "over")]
    end += [F.when(itself, alone).otherwise(F.col(c)).alias(c) for c, alone in (("first_n", F.lit(0)), ("first_words", F.lit(0)), ("first_over", F.col("alone_over")))]
    ends = own.join(matches, ["hi", "lo", "side", "key"]).select("doc_id", "tid", F.struct(*end).alias("end"))
    return ends.groupBy("doc_id", "tid").agg(F.collect_set("end").alias("ends"))  # two for each run of one text


def told_apart(texts: DataFrame) -> DataFrame:
    """doc_id, tid, text: ``tid`` is a hash of the text where different texts share their doc_id, else 0, which costs nothing on its way."""
    hashed = texts.select("doc_id", F.xxhash64("text").alias("tid")).groupBy("doc_id").agg(F.min("tid").alias("low"), F.max("tid").alias("high"))
    several = cut(hashed.filter("low <> high").select("doc_id", F.lit(True).alias("several")))
    listed = F.broadcast(several) if several.count() <= LISTED else several
    return texts.join(listed, "doc_id", "left").select("doc_id", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("tid"), "text")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document with a repeated passage.

    doc_id; n_repeated, repeated_chars: chunks and characters of its repeated passages; n_removed,
    removed_chars: those whose first place is elsewhere before it; spans: the passages as start:end
    (code points), joined by commas; removed: those to cut, which reach as far as the first place does; first_doc_ids:
    documents where they stand first.  Passages need ``min_words`` whole words.

    Null and empty texts have no chunks.  A null doc_id sorts first, as the smallest long.  Different texts
    of one doc_id, or of none, are documents of their own, each with a row; repeated rows are one document
    and do not count as a repeat.  The whole text is chunked, however long; further columns are not read; an
    empty table gives none.  Texts are chunked once, into a table of numbers in the shared folder, where compressed tables
    take the place of checkpoints and go as soon as they are used, and read once more for what stands beside the ends of runs; a digest that many texts hold is joined by Spark's skew join, and the
    texts beside it are put in order by ranges: none is gathered.
    """
    spark = docs.sparkSession
    texts = told_apart(texts_of(docs).filter("text is not null").withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))))
    folder = f"{checkpoint_dir(spark)}/substrings-{uuid.uuid4().hex}"
    # version 2 of the format writes places as small differences
    chunk_table(texts).write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(f"{folder}/chunks")
    chunks, place = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks"), F.struct(*PLACE)
    places = chunks.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # stored, so that the join can split a digest that many texts hold
    shared = stored(places.filter("first < last").select("hi", "lo", *(F.col(f"first.{c}").alias(f"first_{c}") for c in PLACE)), f"{folder}/shared")
    later = place > F.struct(*(F.col(f"first_{c}") for c in PLACE))
    marked = stored(chunks.join(shared, ["hi", "lo"]).select("doc_id", "tid", "at", "size", "hi", "lo", later.alias("later"), F.col("first_doc_id").alias("first_doc")), f"{folder}/marked")
    delete_folder(spark, f"{folder}/chunks")
    delete_folder(spark, f"{folder}/shared")
    chunk = F.struct("at", "size", "hi", "lo", "later", "first_doc")
    gathered = marked.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set(chunk)).alias("chunks"))  # bounded by one text's chunks
    runs = stored(_runs(gathered), f"{folder}/runs")

    # the digests at the ends of runs, and all places that hold them
    one = runs.select(F.explode("runs").alias("r")).select("r.*")
    left = one.filter("start > 0").select(F.col("left_hi").alias("hi"), F.col("left_lo").alias("lo"), F.lit(0).alias("side"))
    right = one.filter("NOT last").select(F.col("right_hi").alias("hi"), F.col("right_lo").alias("lo"), F.lit(1).alias("side"))
    ends = cut(left.unionByName(right).distinct())
    beyond = F.when(F.col("side") == 0, F.col("at") > 0).otherwise(F.col("size") > 0)
    at = F.when(F.col("side") == 0, F.col("at")).otherwise(F.col("at") + F.col("size"))
    asked = marked.join(ends, ["hi", "lo"]).filter(beyond).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("side", "hi", "lo", at.alias("at"))).alias("asked"))
    with_asked = runs.join(asked, ["doc_id", "tid"], "left").select("doc_id", "tid", "runs", "later", "firsts", _or_empty("asked", asked))
    measured = stored(_beside(with_asked.join(texts, ["doc_id", "tid"])), f"{folder}/measured")
    delete_folder(spark, f"{folder}/marked")
    delete_folder(spark, f"{folder}/runs")

    edges = measured.filter("beside IS NOT NULL").select("doc_id", "tid", "run", "side", "hi", "lo", "at", "solid", "beside")
    extensions = _extensions(edges, f"{folder}/beside")
    extended = measured.filter("runs IS NOT NULL").join(extensions, ["doc_id", "tid"], "left").select("doc_id", "tid", "runs", "later", "firsts", _or_empty("ends", extensions))
    found = map_slices(extended, _passages(min_words), "doc_id long, tid long, n_repeated long, repeated_chars long, n_removed long, removed_chars long, spans string, removed string, first_doc_ids array<long>", 1024)
    result = cut(found.distinct().drop("tid"))  # repeated rows
    delete_folder(spark, folder)
    return result


def _or_empty(name: str, typed: DataFrame):
    return F.coalesce(name, F.array().cast(typed.schema[name].dataType)).alias(name)


def _passages(min_words: int):
    def work(part: pa.RecordBatch) -> Iterator[list]:
        (n_runs, r), (n_later, p), (n_firsts, f), (n_ends, e) = (list_fields(part.column(c)) for c in ("runs", "later", "firsts", "ends"))
        rows, first = np.arange(part.num_rows), np.cumsum(n_runs) - n_runs
        of_run, of_later, of_first, of_end = (np.repeat(rows, n) for n in (n_runs, n_later, n_firsts, n_ends))
        at_end = {}
        for side, end in ((0, "left"), (1, "right")):
            this = e["side"] == side
            run = (first[of_end] + e["run"])[this]
            for name in ("n", "words", "over", "first_n", "first_words", "first_over"):
                at_end[end, name] = np.zeros(len(of_run), np.int64)
                at_end[end, name][run] = e[name][this]
        words = r["words"] + at_end["left", "words"] + at_end["right", "words"] - at_end["right", "over"]
        kept = np.maximum(0, words) >= min_words
        start, end = r["start"] - at_end["left", "n"], r["end"] + at_end["right", "n"]

        run = first[of_later] + p["run"]
        opens, closes = p["start"] == r["start"][run], p["end"] == r["end"][run]
        cut_start = p["start"] - opens * at_end["left", "first_n"][run]
        cut_end = p["end"] + closes * at_end["right", "first_n"][run]
        words = p["words"] + opens * at_end["left", "first_words"][run] + closes * at_end["right", "first_words"][run]
        words -= np.where(closes, at_end["right", "first_over"][run], p["over"])
        gone = kept[run] & (np.maximum(0, words) >= min_words)
        doc = f["doc"][kept[first[of_first] + f["run"]]]

        ids, tids = part.column("doc_id").to_pylist(), part.column("tid").to_pylist()
        in_doc = lambda of, chosen: np.append(0, np.cumsum(np.bincount(of[chosen], minlength=len(rows)))).tolist()
        spans_at, gone_at, firsts_at = in_doc(of_run, kept), in_doc(of_later, gone), in_doc(of_first, kept[first[of_first] + f["run"]])
        spans, chunks = list(zip(start[kept].tolist(), end[kept].tolist())), np.append(0, np.cumsum(r["chunks"][kept])).tolist()
        removed, gone_chunks = list(zip(cut_start[gone].tolist(), cut_end[gone].tolist())), np.append(0, np.cumsum(p["chunks"][gone])).tolist()
        firsts = doc.tolist()
        out: list[list] = [[] for _ in range(9)]
        size = lambda x: sum(b - a for a, b in x)
        write = lambda x: ",".join(f"{a}:{b}" for a, b in x)
        for i in np.flatnonzero(np.diff(spans_at)).tolist():
            (a, b), (c, d) = spans_at[i : i + 2], gone_at[i : i + 2]
            mine, cuts = _united(spans[a:b]), _united(removed[c:d])
            theirs = sorted(set(firsts[firsts_at[i] : firsts_at[i + 1]]) - {ids[i]})
            for column, value in zip(out, (ids[i], tids[i], chunks[b] - chunks[a], size(mine), gone_chunks[d] - gone_chunks[c], size(cuts), write(mine), write(cuts), theirs)):
                column.append(value)
        yield out

    return work


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
