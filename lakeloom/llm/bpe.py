"""BPE encoding and decoding through a table of distinct words.

Byte-level BPE never merges across the edge between white space and what follows a word, so a text is the sequence of its
*units* (white space and the run of other characters after it), and the ids of a text are the ids of its units one after
another. Per chunk of documents Spark emits every distinct unit once; the units of all chunks meet by hash and are told apart by their bytes, each
distinct unit of a key partition is encoded once, and its ids go back to the chunks, where they are joined by position. Decoding
joins ids with the id-to-piece table of the vocabulary (of fixed size) and concatenates the pieces' bytes.

Nulls count as empty texts. Repeated rows give repeated rows. An empty text has no ids and decodes to the empty text. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lakeloom.llm._common import CHUNK_SCHEMA, Texts, by_part, chunk_batch, chunks, distinct, key_parts, ragged, read_chunk, split, squeeze, text_chunks, tidied, tidy, tune, unsqueeze, word_hashes


def load(path: str, ordinary: bool = False):
    """The tokenizers library's tokenizer of a file, one per worker process; without truncation and padding. ordinary: the
    strings of special tokens in a text are encoded as other text."""
    found = _LOADED.get((path, ordinary))
    if not found:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = _LOADED[path, ordinary] = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        found.encode_special_tokens = ordinary
    return found


_LOADED: dict = {}


def unicode_space(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to a character of Unicode's White_Space."""
    out = (data == 32) | ((data >= 9) & (data <= 13))
    if len(data) > 1 and (data >= 0x80).any():
        a, b = data[:-1], data[1:]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        out[:-1] |= two
        out[1:] |= two
        if len(data) > 2:
            a, b, c = data[:-2], data[1:-1], data[2:]
            three = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            three |= ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
            for k in range(3):
                out[k : len(data) - 2 + k] |= three
    return out


def units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and where each text's units begin: they cover the buffer without gaps. White space at
    the end of a text is a unit of its own."""
    _, word_ends, _ = split(texts, unicode_space)
    cuts = np.unique(np.concatenate([word_ends, texts.offsets]))
    cuts = cuts[(cuts > 0) & (cuts < len(texts.data))] if len(texts.data) else cuts[:0]
    n = int(len(texts.data) > 0)
    starts = np.concatenate([np.zeros(n, np.int64), cuts])
    ends = np.concatenate([cuts, np.full(n, len(texts.data), np.int64)])
    return starts, ends, np.searchsorted(starts, texts.offsets)


def encode_words(path: str, words: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units one after another, and how many each has. Units that begin with a space and go on with something else are
    given to the library many at once, one after another: they do not change each other's ids, and the bytes of the ids say where
    each unit ends. All others are given to it one by one."""
    n, data = len(words), words.data
    first, last = words.offsets[:-1], words.offsets[1:]
    some = first < last
    joined = np.zeros(n, bool)
    joined[some] = (data[first[some]] == 32) & ~unicode_space(data)[last[some] - 1]
    together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
    tokenizer, lengths, parts = load(path), np.zeros(n, np.int64), []
    sizes = pc.binary_length(pieces(path)).to_numpy().astype(np.int64)
    for i in range(0, len(together), AT_ONCE):
        own = together[i : i + AT_ONCE]
        size = (last - first)[own]
        ids = np.array(tokenizer.encode_batch_fast([data[ragged(first[own], size)].tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends, wanted = np.cumsum(sizes[ids]), np.cumsum(size)
        cuts = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[cuts], wanted):
            raise AssertionError("units and ids do not agree")
        lengths[own] = np.diff(np.concatenate([[-1], cuts]))
        parts.append(ids)
    rest = [e.ids for k in range(0, len(alone), 20_000) for e in tokenizer.encode_batch_fast([words.bytes_of(j).decode(errors="replace") for j in alone[k : k + 20_000]], add_special_tokens=False)]
    lengths[alone] = [len(x) for x in rest]
    parts.append(np.array([i for x in rest for i in x], np.uint32))
    order, flat, begin = np.concatenate([together, alone]), np.concatenate(parts), np.zeros(n, np.int64)
    begin[order] = np.cumsum(lengths[order]) - lengths[order]
    return flat[ragged(begin, lengths)], lengths


AT_ONCE = 1 << 15


def pieces(path: str) -> pa.Array:
    """Bytes of each id of a byte-level vocabulary (holes are empty)."""
    found = _PIECES.get(path)
    if found is None:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocabulary = load(path).get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            table[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        found = _PIECES[path] = pa.array(table, pa.binary())
    return found


_PIECES: dict = {}


def decode(path: str, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The text in UTF-8 of each ids[bounds[i]:bounds[i + 1]]; incomplete characters become U+FFFD."""
    table, out, i = pieces(path), [], 0
    while i + 1 < len(bounds):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 20), "right")) - 1)
        lists = pa.ListArray.from_arrays(pa.array((bounds[i : j + 1] - bounds[i]).astype(np.int32)), table.take(pa.array(ids[bounds[i] : bounds[j]])))
        for x in pc.binary_join(lists, b"").to_pylist():
            try:
                x.decode()
            except UnicodeDecodeError:
                x = x.decode(errors="replace").encode()
            out.append(x)
        i = j
    return out


def _distinct(texts: Texts, parts: int):
    """Where each text's units begin, the distinct units by their bytes, for each unit the number of its distinct one, and
    the key partition of each distinct unit."""
    starts, ends, bounds = units(texts)
    own, inverse = distinct(texts, starts, ends)
    return bounds, own, inverse, (word_hashes(own, own.offsets[:-1], own.offsets[1:]) % np.uint64(parts)).astype(np.int64)


def _chosen(texts: Texts, members: np.ndarray) -> Texts:
    lengths = np.diff(texts.offsets)[members]
    return Texts(texts.data[ragged(texts.offsets[members], lengths)], np.concatenate([[0], np.cumsum(lengths)]))


def encode(docs: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """docs(doc_id long, text string) → doc_id, ids (little-endian unsigned 32-bit, binary), n_tokens. path: a byte-level
    tokenizers file. parts: key partitions; a key partition's units (those of each chunk) should fit one task's memory."""
    tune(docs.sparkSession)
    parts = parts or key_parts(docs.sparkSession)

    def words(batches):
        for chunk, _, texts in chunks(batches):
            _, every, _, part = _distinct(texts, parts)
            rows = []
            for p, members in by_part(part, parts):
                own = _chosen(every, members)
                rows.append((chunk, p, b"", np.diff(own.offsets).astype(np.uint32).tobytes(), squeeze(own.data.tobytes())))
            if rows:
                yield chunk_batch(rows)

    def once(group: pa.Table) -> pa.Table:
        """Encodes each distinct word of a key partition, and answers each chunk in the order it asked."""
        lists = []
        for lengths, data in zip(group.column("lengths").to_pylist(), group.column("data").to_pylist(), strict=True):
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.uint32))]).astype(np.int64)
            lists.append(Texts(np.frombuffer(unsqueeze(data), np.uint8), offsets))
        every = Texts.join(lists)
        once, inverse = distinct(every, every.offsets[:-1], every.offsets[1:])
        ids, lengths = encode_words(path, once)
        begins, at, rows = np.cumsum(lengths) - lengths, 0, []
        for chunk, part, own in zip(group.column("chunk").to_pylist(), group.column("part").to_pylist(), lists, strict=True):
            which = inverse[at : at + len(own)]
            at += len(own)
            rows.append((chunk, part, b"", squeeze(lengths[which].astype(np.uint32).tobytes()), squeeze(ids[ragged(begins[which], lengths[which])].tobytes())))
        tidy()
        return pa.Table.from_batches([chunk_batch(rows)])

    def back(group: pa.Table) -> pa.Table:
        (keys, texts), answers = read_chunk(group)
        bounds, every, inverse, part = _distinct(texts, parts)
        members = [m for _, m in by_part(part, parts)]
        lengths = [np.frombuffer(unsqueeze(a[2]), np.uint32).astype(np.int64) for a in answers]
        ids = np.concatenate([np.frombuffer(unsqueeze(a[3]), np.uint32) for a in answers]) if answers else np.empty(0, np.uint32)
        length, begin = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        if members:
            order, flat = np.concatenate(members), np.concatenate(lengths)
            length[order], begin[order] = flat, np.cumsum(flat) - flat
        per_unit = length[inverse]
        ends = np.concatenate([[0], np.cumsum(per_unit)])[bounds]
        sequence = ids[ragged(begin[inverse], per_unit)].astype("<u4")
        return pa.table({"doc_id": keys, "ids": pa.array([sequence[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), "n_tokens": pa.array(np.diff(ends), pa.int64())})

    asked = docs.select("doc_id", "text").mapInArrow(tidied(words), CHUNK_SCHEMA)
    answered = asked.groupBy("part").applyInArrow(once, CHUNK_SCHEMA)
    return text_chunks(docs).unionByName(answered).groupBy("chunk").applyInArrow(back, "doc_id long, ids binary, n_tokens long")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids, n_tokens) → those columns and text_utf8 (binary)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int64)
            texts = decode(path, np.frombuffer(b"".join(lists), "<u4"), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "n_tokens", "text_utf8"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(tidied(run), "doc_id long, ids binary, n_tokens long, text_utf8 binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids, n_tokens) → doc_id, n_tokens, ids_sha256, decoded_sha256 (see decode_ids)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int64)
            texts = decode(path, np.frombuffer(b"".join(lists), "<u4"), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (lists, texts))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
