"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document is its token ids and the end id. Whole multiples of the sequence length fill sequences of their own; the rest of each
document is a piece that first-fit decreasing places, longest first, into the leftmost open bin that has room. The tree holds the
largest free capacity below each node, so a placement takes a logarithm of the number of bins. Documents may be cut, so the emptiest
bins then give their ids to fill the gaps of the others, and what remains at the end of a group becomes sequences whose
lengths are powers of two, which need no padding. Groups come from a hash of the document and of its place among its copies, so they
hold about ``GROUP_BYTES`` of text at every size of the input, however many rows are equal, and pack independently. Null text is one end id.
Repeated rows are separate documents. A text of any length fills as many sequences as it needs. Pieces of equal length are placed in the order
of their rows. An empty table gives no rows. The result's columns are fixed, so columns of the input cannot clash with them, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import slices, text_buffers, tidy, tidy_table

#: Ids of a sequence, the id that ends a document, text of a group and what a row counts besides its text, in bytes.
SEQUENCE, END_ID, GROUP_BYTES, ROW_BYTES = 4096, 2, 16 << 20, 64
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 1_200_000
#: Bytes of text that a task splits at a time.
PART_BYTES = 8 << 20
_cache: dict[str, bytes] = {}
_tokenizers: dict[str | tuple[str, str], object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _plain_model(path: str):
    """(model, letters): the model itself for words that its normaliser and its splitting leave as they are, and how it spells the letters that are not ASCII."""
    if (path, "plain") not in _tokenizers:
        from tokenizers import pre_tokenizers

        spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c) != "÷"]
        _tokenizers[path, "plain"] = (_tokenizer(path).model, {ord(c): spelling.pre_tokenize_str(c)[0][0] for c in letters})
    return _tokenizers[path, "plain"]


#: A run of lower-case letters of ASCII and Latin-1 (composed), then signs of ASCII that begin none of the tokenizer's contractions.
_PARTS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _encode_others(words: list[str], path: str) -> None:
    """Remembers the ids of words through the whole tokenizer, 512 at a time, parted by a mark that is always one id."""
    encode = lambda texts: [np.array(e.ids, "<u2") for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    whole = _tokenizer(path)
    alone = [w for w in words if "!" in w or "<|" in w]
    rest = [w for w in words if "!" not in w and "<|" not in w]
    for word, ids in zip(alone, encode(alone), strict=True):
        _cache[word] = ids.tobytes()
    (mark,) = encode(["!"])[0]
    for a in range(0, len(rest), 512):
        part = rest[a : a + 512]
        ids = encode([" ! ".join(part)])[0]
        raw, start = ids.tobytes(), 0
        for word, end in zip(part, [*np.flatnonzero(ids == mark).tolist(), len(ids)], strict=True):
            _cache[word] = raw[2 * start : 2 * end]
            start = end + 1


def word_ids(words: list[str], path: str, limit: int = CACHE_WORDS) -> dict[str, bytes]:
    """Fills the worker's memory with the ids (unsigned 16 bits) of words that are new to it.

    The tokenizer parts letters from the signs after them, so both are remembered apart; letters go straight to its model, which its normaliser would
    not change. Letters of Latin-1 are lower-cased each by itself.
    """
    if len(_cache) + len(words) > limit:
        for w in list(islice(_cache, max(len(_cache) // 2, len(_cache) - limit // 2))):
            del _cache[w]
    model, letters = _plain_model(path)
    parted, others = [], []
    for w in words:
        if w in _cache:
            continue
        m = _PARTS.fullmatch(w if w.isascii() or max(w) > "ÿ" else w.lower())
        if m is None:
            others.append(w)
            continue
        core, signs = m.groups()
        if core not in _cache:
            _cache[core] = array("H", [t.id for t in model.tokenize(core if core.isascii() else core.translate(letters))]).tobytes()
        if core != w:
            parted.append((w, core, signs))
    _encode_others(others + [x for x in {x for _, _, x in parted} if x not in _cache], path)
    for w, core, signs in parted:
        _cache[w] = _cache[core] + (_cache[signs] if signs else b"")
    return _cache


def tokenise(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """key, ids (binary, unsigned 16 bits little-endian, end id last), n_ids, copy (told apart by it: rows with equal key and ids).

    The tokenizer never joins across white space, so words are encoded once each. copy depends on the rows of a partition, not on their order, so a task that
    runs again deals the same rows out in the same way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = TaskContext.get().partitionId() << 32, Counter()
        end = pa.scalar(np.array([END_ID], "<u2").tobytes(), pa.binary())
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, PART_BYTES):
                texts = pc.fill_null(batch.column(1).slice(a, b - a), "")
                marked = pc.match_substring(texts, "<|")
                words = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
                coded = words.flatten().dictionary_encode()
                different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
                known = word_ids(different, tokenizer, cache_words)
                ids = pa.array([known[w] for w in different], pa.binary()).take(coded.indices)
                ends = np.frombuffer(ids.buffers()[1], np.int32)[words.offsets.to_numpy() - words.offsets[0].as_py()]
                whole = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), ids.buffers()[2]])
                whole = pc.binary_join_element_wise(whole, end, pa.scalar(b"", pa.binary()))
                keys, copies = batch.column(0).slice(a, b - a), []
                for name in zip(keys.to_pylist(), map(xxhash.xxh3_64_intdigest, whole.to_pylist()), strict=True):
                    copies.append(place + seen[name])
                    seen[name] += 1
                yield pa.RecordBatch.from_arrays([keys, whole, pa.array(np.diff(ends) // 2 + 1, pa.int64()), pa.array(copies, pa.int64())], names=["key", "ids", "n_ids", "copy"])

    return df.select(key, text).mapInArrow(tidy(run), f"key {df.schema[key].dataType.simpleString()}, ids binary, n_ids long, copy long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. A tournament tree over all possible bins gives the leftmost bin with room."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    free = [capacity] * (2 * width)
    bins: list[list[int]] = []
    for i in order:
        node = 1
        while node < width:
            node *= 2
            if free[node] < sizes[i]:
                node += 1
        if node - width == len(bins):
            bins.append([])
        bins[node - width].append(i)
        free[node] -= sizes[i]
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
    return bins


def pack(sizes: list[int], capacity: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold each id of each item once."""
    out = [[(i, s, capacity)] for i, n in enumerate(sizes) for s in range(0, n - capacity + 1, capacity)]
    rest = [(i, n - n % capacity, n % capacity) for i, n in enumerate(sizes) if n % capacity]
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([n for _, _, n in rest], capacity)]
    bins.sort(key=lambda b: -sum(n for _, _, n in b))
    loads = [sum(n for _, _, n in b) for b in bins]
    last = len(bins) - 1
    for k in range(len(bins)):
        while k < last and loads[k] < capacity:
            i, s, n = bins[last].pop()
            take = min(n, capacity - loads[k])
            bins[k].append((i, s, take))
            loads[k] += take
            loads[last] -= take
            if take < n:
                bins[last].append((i, s + take, n - take))
            if not bins[last]:
                last -= 1
    for k in range(last + 1):
        if loads[k] == capacity:
            out.append(bins[k])
        else:
            out += _powers_of_two(bins[k], loads[k])
    return out


def _powers_of_two(pieces: list[tuple[int, int, int]], load: int) -> list[list[tuple[int, int, int]]]:
    out, pieces = [], list(pieces)
    while load:
        room = 1 << (load.bit_length() - 1)
        load -= room
        out.append([])
        while room:
            i, s, n = pieces.pop(0)
            take = min(n, room)
            out[-1].append((i, s, take))
            room -= take
            if take < n:
                pieces.insert(0, (i, s + take, n - take))
    return out


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    size = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    kind = df.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = table.column("grp")[0].as_py()
        ids = [np.frombuffer(x.as_py(), "<u2").astype("<u4") for x in table.column("ids")]
        keys = table.column("key")
        rows = []
        for number, pieces in enumerate(pack([len(x) for x in ids])):
            offset = 0
            for i, s, n in pieces:
                rows.append((i, s, n, zlib.crc32(ids[i][s : s + n].tobytes()), len(ids[i]), group << 32 | number, offset))
                offset += n
        columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
        return pa.table([keys.take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = tokenise(df, tokenizer, key, text, cache_words).withColumn("grp", F.pmod(F.xxhash64("key", "ids", "copy"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(tidy_table(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
