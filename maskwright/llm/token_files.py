"""Token ids in binary shard files with keyed, constant-time access.

Documents are put in ascending doc_id order by Spark's range partitioning (rows of one
doc_id by a hash of their text, so that no key, null neither, has to fit one task), each
partition encodes its texts and writes its own shards, and a manifest table tells
the shards' paths, key ranges and sizes. A shard file (little-endian):

    magic ``MWTOKEN2`` | header length uint32 | header JSON | sections
    keys      int64[n]   document keys in file order
    starts    uint64[n+1] first id of each document
    bits      uint64[]   minimal perfect hash: the bit fields of all levels
    ranks     uint32[]   set bits before each block of 512 bits
    prints    uint32[n]  stored fingerprint of the key in each hash slot
    places    uint32[n]  the key's first place in file order in each hash slot
    payload   uint16[] or uint32[], raw ids (uint16 if the vocabulary fits)

The hash has a bit field a level: keys alone on their bit are placed there, the
others go on to the next level, so a look-up takes a constant number of probes on
average; the rank of the bit (the block's sample and the bits before it in its block) is
the slot. A look-up reads a few bytes of each section at known offsets, whatever the
shard's size. A fingerprint tells absent keys.

Files are written under another name and then renamed, and hold the same bytes
whenever a task is repeated, so lost executors and speculation do no harm.

Null texts are encoded as empty (the end id alone). Null keys stand first, can't
be looked up, and have the key -2**63 in the file (no document may have that key). Of
repeated keys a look-up gives the first. Empty tables give no shard. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import shared_dir, spread, written
from .words import mix

MAGIC = b"MWTOKEN2"
BLOCK = 512  # bits between two rank samples
NULL_KEY = -(2**63)
_SEED = np.uint64(0xA0761D6478BD642F)
_MUL_B = np.uint64(0xD6E8FEB86659FD93)


# -- minimal perfect hash ---------------------------------------------------


def _place(key: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(key + np.uint64((level + 1) * int(_SEED) & (1 << 64) - 1)) % np.uint64(size)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the bits of all levels as words, and the set bits before each block of
    eight words, for distinct uint64 keys."""
    sizes, fields, left = [], [], keys
    while len(left):
        size = 2 * len(left) + 63 & ~63
        at = _place(left, len(sizes), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        fields.append(alone)
        left = left[~alone[at]]
    flat = np.concatenate(fields) if fields else np.zeros(0, bool)
    flat = np.concatenate([flat, np.zeros(-len(flat) % BLOCK, bool)])
    words = np.packbits(flat, bitorder="little").view("<u8")
    ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1)
    return sizes, words, (np.cumsum(ones) - ones).astype("<u4")


def slot_of(keys: np.ndarray, sizes: list[int], words, ranks) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit. ``words`` gives the words of blocks
    (an array of block numbers) and ``ranks`` their samples: what one key needs is one of each a level."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + _place(keys[left], level, size).astype(np.int64)
        block = at // BLOCK
        held, inside = words(block), at % BLOCK
        word, bit = held[np.arange(len(at)), inside // 64], np.uint64(1) << (inside % 64).astype(np.uint64)
        hit = (word & bit) != 0
        before = np.bitwise_count(held) * (np.arange(BLOCK // 64) < (inside // 64)[:, None])
        out[left[hit]] = (ranks(block) + before.sum(axis=1) + np.bitwise_count(word & (bit - np.uint64(1))))[hit]
        left, base = left[~hit], base + size
    return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)


# -- shard files ------------------------------------------------------------


def shard_head(keys: np.ndarray, counts: np.ndarray, dtype: str) -> bytes:
    """All of a shard file before its payload."""
    named = np.unique(keys[keys != NULL_KEY], return_index=True)
    distinct, place = named[0].astype(np.int64).view(np.uint64), np.flatnonzero(keys != NULL_KEY)[named[1]]
    sizes, words, ranks = build_hash(distinct)
    slot = slot_of(distinct, sizes, lambda b: words.reshape(-1, BLOCK // 64)[b], lambda b: ranks[b].astype(np.int64))
    prints, places = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slot], places[slot] = fingerprint(distinct), place
    sections = [keys.astype("<i8"), np.concatenate([[0], np.cumsum(counts)]).astype("<u8"), words, ranks, prints, places]
    header = json.dumps({"docs": len(keys), "named": len(distinct), "levels": sizes, "words": len(words), "dtype": dtype}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *(x.tobytes() for x in sections)])


def _fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """``file:/x`` as Spark may write it, in the form Arrow reads."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class Shard:
    """Reads one shard file. Only its header is held; every access reads the bytes it needs."""

    def __init__(self, path: str):
        fs, name = _fs(_uri(path))
        self.file = fs.open_input_file(name)
        head = self.file.read_at(12, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        size = int.from_bytes(head[8:], "little")
        self.header = h = json.loads(self.file.read_at(size, 12))
        self.docs, self.levels, at = h["docs"], h["levels"], 12 + size
        self.sections, self.loaded = {}, {}
        for part, dtype, n in (
            ("keys", "<i8", h["docs"]), ("starts", "<u8", h["docs"] + 1), ("words", "<u8", h["words"]), ("ranks", "<u4", h["words"] * 64 // BLOCK),
            ("prints", "<u4", h["named"]), ("places", "<u4", h["named"]), ("payload", h["dtype"], None),
        ):
            self.sections[part] = (at, np.dtype(dtype), n)
            at += 0 if n is None else np.dtype(dtype).itemsize * n

    def read(self, part: str, first: int, n: int) -> np.ndarray:
        if part in self.loaded:
            return self.loaded[part][first : first + n]
        at, dtype, _ = self.sections[part]
        return np.frombuffer(self.file.read_at(n * dtype.itemsize, at + first * dtype.itemsize), dtype)

    def load(self):
        """Holds all but the payload, for look-ups of most keys."""
        self.loaded = {part: self.read(part, 0, n) for part, (_, _, n) in self.sections.items() if n is not None}

    def _each(self, part: str, at: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` values from each of the places ``at * n`` on."""
        if part in self.loaded:
            return self.loaded[part].reshape(-1, n)[at]
        return np.array([self.read(part, int(x) * n, n) for x in at], self.sections[part][1]).reshape(len(at), n)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The first place in file order of each int64 key, -1 for absent ones."""
        k = keys.view(np.uint64)
        slot = slot_of(k, self.levels, lambda b: self._each("words", b, BLOCK // 64), lambda b: self._each("ranks", b)[:, 0].astype(np.int64))
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(slot >= 0)
        some = some[self._each("prints", slot[some])[:, 0] == fingerprint(k[some])]
        place = self._each("places", slot[some])[:, 0].astype(np.int64)
        right = self._each("keys", place)[:, 0] == keys[some]
        out[some[right]] = place[right]
        return out

    def ids(self, place: int, upto: int | None = None) -> np.ndarray:
        """The ids of the documents from ``place`` to before ``upto``."""
        upto = place + 1 if upto is None else upto
        a = int(self.read("starts", place, 1)[0])
        return self.read("payload", a, int(self.read("starts", upto, 1)[0]) - a)

    def look_up(self, key: int) -> np.ndarray | None:
        """The ids of the document with this key, or None."""
        place = int(self.places(np.array([key], np.int64))[0]) if key != NULL_KEY else -1
        return None if place < 0 else self.ids(place)

    def close(self):
        self.file.close()


# -- encoding ---------------------------------------------------------------


#: where texts are cut, and what sends a text to the library whole
_CUTS, _ODD = np.zeros(256, bool), np.zeros(256, bool)
_CUTS[[32, 10]] = True
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_PLAIN = np.zeros(256, bool)  # ASCII letters and digits
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True
_LEADS = np.zeros(256, bool)  # first bytes of two-byte letters: Latin to U+017F, Cyrillic to U+047F
_LEADS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
_SPACE_LEADS = np.zeros(256, bool)  # first bytes of white space beyond ASCII
_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _odd_rows(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The rows that hold white space other than single spaces and line ends inside the text."""
    cut = _CUTS[buf]
    full = np.flatnonzero(offs[:-1] < offs[1:])
    odd = np.zeros(len(offs) - 1, bool)
    odd[full] = cut[offs[full]] | cut[offs[full + 1] - 1]
    twice = np.flatnonzero(cut[1:] & cut[:-1])
    wide = np.flatnonzero(_SPACE_LEADS[buf])
    two, three = buf[np.minimum(wide + 1, len(buf) - 1)], buf[np.minimum(wide + 2, len(buf) - 1)]
    lead = buf[wide]
    space = (lead == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (lead == 0xE1) & (two == 0x9A) & (three == 0x80) | (lead == 0xE3) & (two == 0x80) & (three == 0x80)
    space |= (lead == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
    for found in (twice, wide[space], np.flatnonzero(_ODD[buf])):
        odd[np.searchsorted(offs, found, side="right") - 1] = True
    return odd


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library.

    Such a tokenizer always starts a new word at a single space or line end between two
    characters that are not white space, so a text's ids are those of its parts cut
    there, each with the separator before it. The parts of a batch are found by byte
    masks, each distinct one is encoded once by the library and kept in a table of bounded
    size, and the batch's ids are gathered from that table by offsets. A part is told by
    128 bits of its bytes (all of them up to 8 bytes) and the separator. A comma or full
    stop behind a letter or digit is a word of its own, so only what stands before it is learnt.
    Texts with other white space, or with separators at an end or side by side, go to the
    library whole.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.limit = limit
        self.stops = np.zeros(256, self.dtype)
        for stop in ",.":
            self.stops[ord(stop)] = self._library([stop])[0][0]
        self.line_end = self._library(["\n"])[0][0]
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.spaced = np.array([p.startswith("Ġ") for p in pieces])  # a space and what follows
        self._clear()

    def _clear(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool, self.end = np.zeros(1 << 16, self.dtype), 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], sep: int) -> list[np.ndarray]:
        """The ids of each word with its separator before it (0: none). With one they go to the
        library as one text: only a word's first id is or begins with the separator."""
        if not words:
            return []
        if not sep:
            return self._library(words)
        mark = chr(sep)
        ids = self._library([mark + mark.join(words)])[0]
        edge = np.flatnonzero(self.spaced[ids] if sep == 32 else ids == self.line_end)
        return np.split(ids, edge[1:]) if len(edge) == len(words) and edge[0] == 0 else self._library([mark + w for w in words])

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for unknown ones."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def _add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray):
        """Adds entries, in key order, whose ids stand one after the other."""
        if self.end + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.zeros(len(ids) + self.end, self.dtype)])
        self.pool[self.end : self.end + len(ids)] = ids
        at = self.end + np.cumsum(size) - size
        self.end += len(ids)
        order = np.argsort(np.concatenate([self.key, key]), kind="stable")
        for name, more in (("key", key), ("check", check), ("at", at), ("size", size), ("used", np.zeros(len(key), bool))):
            setattr(self, name, np.concatenate([getattr(self, name), more])[order])

    def _ids(self, entry: np.ndarray) -> np.ndarray:
        """The ids of the entries, one after the other."""
        size = self.size[entry]
        return self.pool[np.repeat(self.at[entry] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def _shrink(self, more: int):
        """Makes room: entries that no later batch has met since the last time go; if that isn't enough, all."""
        if len(self.key) + more <= self.limit:
            return
        keep = np.flatnonzero(self.used)
        if len(keep) + more > self.limit * 3 // 4:
            self._clear()
            return
        ids, size, key, check = self._ids(keep), self.size[keep], self.key[keep], self.check[keep]
        self._clear()
        self._add(key, check, ids, size)

    @staticmethod
    def _keys(buf, s, e, sep):
        k = W.keys(buf, s, e)
        c = k if not len(s) else np.where(e - s > 8, W.keys(buf, s, e, _MUL_B), k)
        return W.mix(k + W.mix(sep.astype(np.uint64) + ((e - s).astype(np.uint64) << np.uint64(8)))), c

    def _learn(self, buf, s, e, sep):
        """Adds the parts, none of which is known, and what their stops stand behind."""
        last, before, lead = buf[e - 1], buf[np.maximum(e - 2, 0)], buf[np.maximum(e - 3, 0)]
        letter = _PLAIN[before] | (before >= 128) & (before < 192) & _LEADS[lead] & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
        stop = (self.stops[last] > 0) & (e - s > 1) & letter & ~((before >= 128) & (e - s < 3))
        stem = e - stop
        k, c = self._keys(buf, s, stem, sep)
        key, rep = np.unique(k, return_index=True)
        rep = rep[self._find(key) < 0]
        for kind in (0, 10, 32):
            own = rep[sep[rep] == kind]
            own = own[np.argsort(k[own])]
            ids = self._words([buf[x:y].tobytes().decode() for x, y in zip(s[own].tolist(), stem[own].tolist())], kind)
            if ids:
                self._add(k[own], c[own], np.concatenate(ids), np.array([len(x) for x in ids]))
        more = np.flatnonzero(stop)
        if len(more):
            k2, c2 = self._keys(buf, s[more], e[more], sep[more])
            order = np.argsort(k2)
            more, k2, c2 = more[order], k2[order], c2[order]
            entry = self._find(k[more])
            right = self.check[entry] == c[more]
            more, k2, c2, entry = more[right], k2[right], c2[right], entry[right]
            size = self.size[entry]
            ids, whole = self._ids(entry), np.ones(size.sum() + len(more), bool)
            ends = np.cumsum(size + 1) - 1
            whole[ends] = False
            out = np.empty(len(whole), self.dtype)
            out[whole], out[ends] = ids, self.stops[last[more]]
            self._add(k2, c2, out, size + 1)

    def encode(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of each row, all ids one after the other), the end id behind each row's."""
        for a, b, buf, offs in W.slices(column):
            rows = b - a
            odd = _odd_rows(buf, offs)
            s, e, first = W.spans(buf, offs, ~_CUTS)
            row = np.repeat(np.arange(rows), np.diff(first))
            if odd.any():
                plain = ~odd[row]
                s, e, row = s[plain], e[plain], row[plain]
            sep = np.where(s > offs[row], buf[np.maximum(s - 1, 0)], 0) if len(s) else np.zeros(0, np.uint8)
            k, c = self._keys(buf, s, e, sep)
            key, which = np.unique(k, return_inverse=True)
            rep = np.zeros(len(key), np.int64)
            rep[which] = np.arange(len(k))
            self._shrink(len(key))
            entry = self._find(key)
            self.used[entry[entry >= 0]] = True
            new = rep[entry < 0]
            if len(new):
                self._learn(buf, s[new], e[new], sep[new])
                entry = self._find(key)
            entry = entry[which]
            odd[row[(entry < 0) | (self.check[entry] != c)]] = True  # other bytes with the same 64 bits
            counts = np.bincount(row, self.size[entry], rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
            ids = self._ids(entry)
            if odd.any():
                parts = np.split(ids, np.cumsum(counts)[:-1])
                whole = np.flatnonzero(odd)
                texts = [buf[offs[r] : offs[r + 1]].tobytes().decode() for r in whole.tolist()]
                for r, found in zip(whole.tolist(), self._library(texts)):
                    parts[r], counts[r] = found, len(found)
                ids = np.concatenate(parts)
            out, ends = np.empty(len(ids) + rows, self.dtype), np.cumsum(counts + 1) - 1
            inner = np.ones(len(out), bool)
            inner[ends] = False
            out[inner], out[ends] = ids, end_id
            yield a, counts + 1, out


#: the encoder of this Python worker, which Spark reuses from task to task
_KEPT: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = PieceEncoder(path)
    return _KEPT[path]


_MANIFEST = "part int, number int, path string, docs long, tokens long, first_key {kind}, last_key {kind}"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, shard_mb: int = 64, shard_docs: int = 1_000_000) -> DataFrame:
    """Writes the shards to a folder all executors share and returns the manifest,
    with ``start``: the ids of all shards before."""
    spark = docs.sparkSession
    folder = path or f"{shared_dir(spark)}/shards"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, own = TaskContext.get(), encoder(tokenizer)
        part = context.partitionId()
        fs, base = _fs(_uri(folder))
        fs.create_dir(base, recursive=True)
        keys, counts, ids, number = [], [], [], 0

        def flush():
            name = f"{base}/part-{part:06d}-{number:04d}.bin"
            stage = f"{name}.{context.taskAttemptId()}"
            column, sizes = np.concatenate(keys), np.concatenate(counts)
            with fs.open_output_stream(stage) as out:
                out.write(shard_head(column, sizes, own.dtype))
                for x in ids:
                    out.write(x.tobytes())
            fs.move(stage, name)
            ends = [None if k == NULL_KEY else int(k) for k in (column[0], column[-1])]
            row = [[part], [number], [f"{folder}/part-{part:06d}-{number:04d}.bin"], [len(column)], [int(sizes.sum())], [ends[0]], [ends[1]]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), key_type, key_type])],
                names=["part", "number", "path", "docs", "tokens", "first_key", "last_key"],
            )

        size = rows = 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            column = pc.fill_null(batch.column(0).cast(pa.int64()), NULL_KEY).to_numpy()
            for first, n, found in own.encode(batch.column(1), end_id):
                keys.append(column[first : first + len(n)])
                counts.append(n)
                ids.append(found)
                size, rows = size + found.nbytes, rows + len(n)
                if size >= shard_mb << 20 or rows >= shard_docs:
                    yield flush()
                    keys, counts, ids, number, size, rows = [], [], [], number + 1, 0, 0
        if keys:
            yield flush()

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    ordered = rows.repartitionByRange(spread(docs), "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, _MANIFEST.format(kind=kind)), "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, each: Callable[[np.ndarray], int], block_ids: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, value): ``each`` of every document's ids. Each shard's keys are
    found through its hash, fingerprints and keys checked; rows that repeat a key stand behind its
    first place, those without one before all others."""
    kind = manifest.schema["first_key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                shard.load()
                keys, starts = shard.loaded["keys"], shard.loaded["starts"].astype(np.int64)
                asked, times = np.unique(keys[keys != NULL_KEY], return_counts=True)
                places = shard.places(asked.astype(np.int64))
                if (places < 0).any():
                    raise ValueError(f"{path} holds keys that its hash doesn't find")
                nulls = shard.docs - int(times.sum())
                key = np.concatenate([np.full(nulls, NULL_KEY), np.repeat(asked, times)])
                place = np.concatenate([np.arange(nulls), np.repeat(places - np.cumsum(times) + times, times) + np.arange(times.sum())])
                at = 0
                while at < len(place):
                    # as many as stand one after the other, up to a block
                    end = min(len(place), max(at + 1, int(np.searchsorted(starts[place[at:] + 1], starts[place[at]] + block_ids, "right")) + at))
                    ids, first, where = shard.ids(int(place[at]), int(place[end - 1]) + 1), starts[place[at]], place[at:end]
                    values = [each(ids[a - first : b - first]) for a, b in zip(starts[where].tolist(), starts[where + 1].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[at:end], mask=key[at:end] == NULL_KEY), pa.array(start + starts[where]), pa.array(starts[where + 1] - starts[where]), pa.array(values, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "value"],
                    )
                    at = end
                shard.close()

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(min(n, 10_000)).mapInArrow(read, "doc_id long, start long, n_tokens long, value long").withColumn(
        "doc_id", F.col("doc_id").cast(kind)
    )


def look_up(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the asked keys (a ``doc_id`` column): each key goes to the shard whose
    key range holds it (a row a shard is broadcast) and is found there through the shard's hash."""
    ranges = manifest.select("path", "first_key", "last_key").filter("last_key is not null").orderBy("part", "number").collect()  # a row a shard
    firsts = [r.first_key if r.first_key is not None else NULL_KEY for r in ranges]
    found = keys.sparkSession.sparkContext.broadcast((np.array(firsts, np.int64), np.array([r.last_key for r in ranges], np.int64), [r.path for r in ranges]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = found.value
        path, shard = None, None
        for batch in batches:
            asked = np.sort(np.array([k for k in batch.column(0).to_pylist() if k is not None], np.int64))
            which = np.searchsorted(lasts, asked, "left")  # the first shard that ends at or behind the key
            out = []
            for key, i in zip(asked.tolist(), which.tolist()):
                if i == len(names) or firsts[i] > key:
                    continue
                if names[i] != path:
                    path = names[i]
                    shard = Shard(path)
                ids = shard.look_up(key)
                if ids is not None:
                    out.append((key, ids.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return keys.select(F.col("doc_id").cast("long")).mapInArrow(find, "doc_id long, ids array<int>")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32."""
    return read_shards(write_shards(docs, tokenizer, end_id), crc32).withColumnRenamed("value", "ids_crc32")
