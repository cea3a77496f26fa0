"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece crosses from an ordinary character to a white-space marker, a merge never spans two
chunks of the form ``markers + other characters``, so each chunk can be segmented by itself.  A task
keeps the ids of distinct chunks in a table and joins them back by position.  The table is bounded: chunks
of more than ``LONGEST_KEPT`` characters are segmented each time, and a full table is begun anew, so a
chunk is segmented once a task and table; ids do not depend on it.  The model is checked for that
property; one without it is run on whole texts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .common import map_columns, per_task, texts_of

MARK = "▁"
#: Entries of a task's table (about 200 bytes each), and the longest chunk that is kept in it.
TABLE_ENTRIES = 400_000
LONGEST_KEPT = 48


class ChunkEncoder:
    """The ids of whole texts; equal to the library's encode() without begin or end ids."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.entries = entries
        self.table: dict[str, tuple[int, ...]] = {}
        self.mark_id = self.library.piece_to_id(MARK)
        self.chunks = re.compile(f"{MARK}+[^{MARK}]*").findall
        self.separable = self._separable()

    def _separable(self) -> bool:
        lib = self.library
        pieces = (lib.id_to_piece(i) for i in range(lib.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            return False
        probes = ("a  b", " x", "x ", "   ", "ﬁ½　c", "a\tb", "é", "a b\n c")  # dummy prefix, and an identity normaliser
        return all([i for c in self.chunks(MARK + p.replace(" ", MARK)) for i in self._segment(c)] == lib.encode(p) for p in probes)

    def _segment(self, chunk: str) -> tuple[int, ...]:
        """The library puts one marker in front of what it gets, so the chunk goes in without its first."""
        return (self.mark_id,) if chunk == MARK else tuple(self.library.encode(chunk[1:]))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.separable:
            return self.library.encode(text)
        table, ids = self.table, []
        for chunk in self.chunks(MARK + text.replace(" ", MARK)):
            found = table.get(chunk)
            if found is None:
                found = self._segment(chunk)
                if len(chunk) <= LONGEST_KEPT:
                    if len(table) >= self.entries:
                        table.clear()
                    table[chunk] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the ids of each whole text; a null or empty text has none.

    Very long texts are encoded whole.  Repeated rows give repeated rows, an empty table none.
    """

    @per_task
    def start():
        encoder = ChunkEncoder(model)
        return lambda rows: {"doc_id": rows["doc_id"], "ids": [encoder.encode(t or "") for t in rows["text"]]}

    return map_columns(texts_of(docs), start, "doc_id long, ids array<int>", 256)


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the library's decode of them as text."""

    @per_task
    def start():
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        return lambda rows: rows | {"text": [lib.decode(i or []) for i in rows["ids"]]}

    return map_columns(encoded.select("doc_id", "ids"), start, "doc_id long, ids array<int>, text string", 256)


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, in one pass over the texts.

    A null or empty text has no ids and the digests of the empty string; a null doc_id stays null.  Very long
    texts are encoded whole.  Repeated rows give repeated rows, an empty table none; further columns are not read.
    """

    @per_task
    def start():
        encoder = ChunkEncoder(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def work(rows: dict[str, list]) -> dict[str, list]:
            ids = [encoder.encode(t or "") for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [sha(",".join(map(str, i))) for i in ids],
                "decoded_sha256": [sha(encoder.decode(i) if i else "") for i in ids],
            }

        return work

    return map_columns(texts_of(docs), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 256)
