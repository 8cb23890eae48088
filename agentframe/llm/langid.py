"""Language identification by cross-parsing entropy over suffix automata.

For each language a bounded sample of labelled text becomes a suffix automaton: the automaton accepts exactly the substrings of the sample. A text is
parsed against it from left to right into the longest phrases that occur in the sample (a symbol that never occurs is a phrase of
its own); the number of phrases times log2 of the sample's length, divided by the text's length, estimates the cross
entropy. The language with the least wins; ties go to the name that sorts first. Texts of any length are parsed whole: blocks of ``BLOCK`` bytes step through the
automata side by side, first as if a phrase began with each block, then again from the state that the block before ended in, until the parse meets the earlier
one; when no block's first state changes any more, the phrases are those of one pass over the text.

Every byte of the samples is a symbol of its own; bytes that no sample has share symbol 0, which matches nowhere.

Repeated rows get the same result; an empty table gives no rows. Input columns with the name of an added one give way to it.
Null text and text without a letter give 'und' and score 0. The score is the runner-up's share of the two best phrase counts (1 with one language only).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import SLICE_BYTES, mapped, slices, text_buffers, without

#: Bytes of a block; rounds of parsing all blocks side by side at most; documents, and characters of all of them, a language that are learned from.
BLOCK, ROUNDS, SAMPLE_DOCS, SAMPLE_BYTES = 512, 6, 96, 24_000
#: Places of a long text that its share comes from.
PLACES = 4


class SuffixAutomaton:
    """Transitions of the suffix automaton of a byte string as a dense table; row 0 is 'no match', row 1 the root."""

    def __init__(self, text: bytes, symbol: np.ndarray):
        self.width = int(symbol.max()) + 1
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbol[np.frombuffer(text, np.uint8)].tolist():
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.table = np.zeros((len(step) + 1, self.width), np.int32)
        for s, to in enumerate(step):
            if to:
                self.table[s + 1, list(to)] = np.fromiter(to.values(), np.int32, len(to)) + 1
        self.bits = math.log2(len(text) + 1)

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after symbols, and where a phrase begins with them."""
        at = self.table.reshape(-1)[state * self.width + symbols]
        new = at == 0
        over = np.flatnonzero(new)
        at[over] = self.table[1][symbols[over]]
        return at, new

    def phrases(self, columns: list[np.ndarray], before: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block. columns[t]: the symbols at place t of the blocks long enough, longest blocks first; before: the block before each of
        the same text, a whole one, or -1; place: how many are before it."""
        blocks, steps = len(before), len(columns)
        states, begins = np.zeros((steps, blocks), np.int32), np.zeros((steps, blocks), bool)
        state = np.zeros(blocks, np.int32)
        for t, symbols in enumerate(columns):
            n = len(symbols)
            states[t, :n], begins[t, :n] = self._step(state[:n], symbols)
            state = states[t]
        first = np.zeros(blocks, np.int32)

        def again(own: np.ndarray) -> bool:
            """Parses blocks from the states that the blocks before them end in, as far as that changes them."""
            start = states[steps - 1, before[own]]
            moved = start != first[own]
            own, state = own[moved], start[moved]
            first[own] = state
            changed = len(own) > 0
            for t, symbols in enumerate(columns):
                state, own = state[own < len(symbols)], own[own < len(symbols)]
                if not len(own):
                    break
                state, new = self._step(state, symbols[own])
                begins[t, own] = new
                differ = state != states[t, own]
                states[t, own] = state
                own, state = own[differ], state[differ]
            return changed

        later = np.flatnonzero(before >= 0)
        rounds = 0
        while len(later) and again(later):
            rounds += 1
            if rounds == ROUNDS:  # phrases longer than blocks: from here block by block, each once
                order = later[np.argsort(place[later], kind="stable")]
                for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                    again(part)
                break
        return begins.sum(0)


class LanguageModel:
    """Suffix automata of labelled samples."""

    def __init__(self, samples: dict[str, bytes]):
        samples = {k: _folded(v) for k, v in sorted(samples.items()) if v}
        used = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
        self.symbol = np.zeros(256, np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        lower = np.arange(256)
        lower[65:91] += 32
        self.symbol = self.symbol[lower]
        self.names = list(samples)
        self.automata = [SuffixAutomaton(t, self.symbol) for t in samples.values()]

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): bits of the phrases of each text."""
        lengths = np.diff(offsets)
        per = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), per)
        begin = offsets[:-1][owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
        size = np.minimum(offsets[1:][owner] - begin, BLOCK)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        symbols = self.symbol[data]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        nth = (np.arange(len(order)) - np.repeat(np.cumsum(per) - per, per))[order]
        before = np.where(nth > 0, number[np.maximum(order - 1, 0)], -1)
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        columns = [symbols[begin[:n] + t] for t, n in enumerate(alive.tolist())]
        out = np.zeros((len(lengths), len(self.automata)))
        for k, automaton in enumerate(self.automata):
            out[:, k] = np.bincount(owner, automaton.phrases(columns, before, nth), len(lengths)) * automaton.bits
        return out


def _folded(text: bytes) -> bytes:
    return text.lower()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def sample(df: DataFrame, key: str, text: str, lang: str, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """About docs rows of each language, those with the smallest hash of the key: what is learned from is bounded, whatever the input. Each row gives an equal share of size, long texts from PLACES evenly spread places."""
    rows = df.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, docs / n)))]) if counts else None
    found: dict[str, bytes] = {}
    if counts:
        place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        quota = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(max(PLACES, size // min(docs, n))))])[F.col(lang)]
        part = F.floor(quota / PLACES).cast("int")
        spread = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.substring(text, F.floor((F.length(text) - part) * i / (PLACES - 1)).cast("int") + 1, part))
        own = F.when(F.length(text) <= quota, F.col(text)).otherwise(F.array_join(spread, "\n"))
        chosen = rows.where(place < share[F.col(lang)]).select(F.col(lang).alias("lang"), own.alias("text"), place.alias("place"), F.col(key).cast("string").alias("key"))
        for r in sorted(chosen.collect(), key=lambda r: (r.place, r.key)):
            found[r.lang] = found.get(r.lang, b"") + b"\n" + r.text.encode()
    return found


def identify(df: DataFrame, samples: dict[str, bytes], text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    df = without(df, "lang_pred", "score")
    held = df.sparkSession.sparkContext.broadcast(samples)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            values = batch.column(place)
            for a, b in slices(offsets, SLICE_BYTES):
                part = batch.slice(a, b - a)
                cost = model.costs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                letters = np.array([has_letter(values[i].as_py()) for i in range(a, b)], bool)
                if len(model.names):
                    best = cost.argmin(1)
                    two = np.sort(cost, 1)[:, :2]
                    score = np.where(letters, two[:, 1] / np.maximum(two.sum(1), 1e-9) if len(model.names) > 1 else 1.0, 0.0)
                    names = [model.names[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                else:
                    names, score = ["und"] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return mapped(df, run, "lang_pred string, score double")


_models: dict[int, LanguageModel] = {}


def _model(samples: dict[str, bytes]) -> LanguageModel:
    key = hash(tuple(sorted(samples.items())))
    if key not in _models:
        _models.clear()
        _models[key] = LanguageModel(samples)
    return _models[key]


def language_id(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score for each row, learned from the rows that are not held out."""
    samples = sample(df, key, text, lang)
    out = identify(df.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("__text")), samples, "__text")
    return out.select(key, F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score")
