"""Language ID by partial matching: frozen byte context trees give exact code lengths.

For each language, counts of bytes after contexts of 0 to ``ORDER`` bytes form a tree. A byte's probability in the
longest known context is its count over (n + q), n the context's occurrences and q its different followers; if it has
none there, the escape probability q / (n + q) is paid and the next shorter context is asked; after the empty context
every byte has 1/256. The counts are frozen before scoring, so the code length of a byte depends on it and the ``ORDER``
bytes before it only: contexts are states of one automaton, code lengths a table, and whole batches are scored by
indexing. A text's language is the one with the shortest code; its score is that language's posterior.

Training sees at most about ``PER_LANGUAGE`` labelled rows of each language, drawn by a hash of the id (documented bound;
whole texts). Everything they hold is counted, also what occurs once. Only the text is an input of a prediction. Rows whose
crc32(id) mod 4 is 2 are held out of training.

The table of code lengths has 4 bytes for each context, symbol and language, ``MODEL_BYTES`` at most: all contexts are in it unless it would
be larger, as with very many languages; then each language's commonest ones are, in turn. Languages that wouldn't leave a
table room for contexts of two bytes (``MOST_LANGUAGES``) raise.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled row everything is
``und``; equal code lengths go to the first language by code point; an empty table gives an empty result; null ids are
neither trained on nor held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk

ORDER = 3
PER_LANGUAGE = 4_000
#: Bytes of the broadcast table, and languages, at most.
MODEL_BYTES, MOST_LANGUAGES = 96 << 20, 500
OUT = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs of ORDER + 1 bytes, by language; a text is led by ORDER zero bytes."""
    counts: dict[str, dict[int, int]] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            some = batch.filter(pa.array([x == lang for x in langs]))
            for _, _, data, offsets in tk.chunks(some, "text"):
                found, n = np.unique(_keys(*_led(data, offsets)[:2]), return_counts=True)
                mine = counts.setdefault(lang, {})
                for g, c in zip(found.tolist(), n.tolist(), strict=True):
                    mine[g] = mine.get(g, 0) + c
    for lang, mine in counts.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(mine), "gram": list(mine), "n": list(mine.values())}, schema=_GRAMS)


def _led(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ORDER zero bytes before each; the places of the texts' bytes; the text of each."""
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(data)) + ORDER * (text + 1)
    out = np.zeros(len(data) + ORDER * len(lengths), np.uint8)
    out[at] = data
    return out, at, text


def _keys(led: np.ndarray, at: np.ndarray) -> np.ndarray:
    key = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        key = (key << 8) | led[at - back]
    return key


class Model:
    """The frozen trees of all languages as one automaton."""

    def __init__(self, grams: list[tuple[str, int, int]] | pa.Table):
        if not isinstance(grams, pa.Table):
            grams = pa.Table.from_pylist([dict(zip(_GRAMS.names, g, strict=True)) for g in grams], schema=_GRAMS)
        coded = grams["lang"].combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.langs = sorted(names, key=lambda x: x.encode())
        lang = np.array([self.langs.index(x) for x in names], np.int64)[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
        key, n = grams["gram"].to_numpy(), grams["n"].to_numpy()
        seen = np.unique(key & 255)
        self.symbols = len(seen) + 1  # the last stands for bytes never seen
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self._states(key, n, lang)
        self.cost = np.empty((len(self.contexts) * self.symbols, len(self.langs)), np.float32)
        for k in range(len(self.langs)):  # one language's table in double precision at a time
            mine = lang == k
            self.cost[:, k] = self._code_lengths(key[mine], n[mine]).ravel()

    def __getstate__(self) -> dict:
        """What scoring needs; the contexts' names stay on the driver."""
        return {k: v for k, v in self.__dict__.items() if k not in ("contexts", "suffix")}

    def _states(self, key: np.ndarray, n: np.ndarray, lang: np.ndarray) -> None:
        """Contexts of any language: number by (order, bytes). Shorter ones first; each one's suffix is a context too."""
        self.contexts: dict[tuple[int, int], int] = {(0, 0): 0}
        most = max(257, MODEL_BYTES // (4 * self.symbols * max(1, len(self.langs))))
        for order in range(1, ORDER + 1):
            found, which = np.unique((key >> 8) & ((1 << (8 * order)) - 1), return_inverse=True)
            total = np.bincount(which, n).astype(np.int64) if len(found) else np.zeros(0, np.int64)
            turn = np.full(len(found), len(found))  # the best rank that a context has in any language
            for k in range(len(self.langs)):
                mine = np.bincount(which[lang == k], n[lang == k], len(found))
                rank = np.argsort(-mine, kind="stable")[: np.count_nonzero(mine)]
                turn[rank] = np.minimum(turn[rank], np.arange(len(rank)))
            keep = np.lexsort((-total, turn))[: max(0, most - len(self.contexts))]
            for c in found[np.sort(keep)].tolist():
                if (order - 1, c & ((1 << (8 * (order - 1))) - 1)) in self.contexts:
                    self.contexts[(order, c)] = len(self.contexts)
        # child[state, byte before]: the state one byte longer, or itself marked as the end of the match.
        self.child = np.full((len(self.contexts), 257), -1, np.int32)
        for (order, c), state in self.contexts.items():
            if order:
                self.child[self.contexts[(order - 1, c & ((1 << (8 * (order - 1))) - 1))], c >> (8 * (order - 1))] = state
        self.suffix = np.zeros(len(self.contexts), np.int32)
        for (order, c), state in self.contexts.items():
            if order:
                self.suffix[state] = self.contexts[(order - 1, c & ((1 << (8 * (order - 1))) - 1))]

    def _code_lengths(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits of each symbol in each context, for one language."""
        counts = np.zeros((len(self.contexts), self.symbols), np.float64)
        symbol = self.symbol[key & 255]
        for order in range(ORDER + 1):
            context = (key >> 8) & ((1 << (8 * order)) - 1)
            known, which = np.unique(context, return_inverse=True)
            state = np.array([self.contexts.get((order, c), -1) for c in known.tolist()], np.int64)[which] if len(known) else np.zeros(0, np.int64)
            ok = state >= 0
            np.add.at(counts, (state[ok], symbol[ok]), n[ok])
        out = np.empty_like(counts)
        total, different = counts.sum(axis=1), (counts > 0).sum(axis=1)
        for state in range(len(counts)):  # suffixes come first
            below = out[self.suffix[state]] if state else np.full(self.symbols, 8.0)
            if not total[state]:
                out[state] = below
                continue
            whole = np.log2(total[state] + different[state])
            with np.errstate(divide="ignore"):
                out[state] = np.where(counts[state] > 0, whole - np.log2(counts[state]), below + whole - np.log2(different[state]))
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): exact code lengths."""
        lengths = np.diff(offsets)
        total = np.zeros((len(lengths), len(self.langs)))
        if not len(data):
            return total
        led, at, _ = _led(data, offsets)
        state = np.zeros(len(at), np.int32)
        flat, going = self.child.ravel(), None
        for back in range(1, ORDER + 1):
            after = flat[state * np.int32(257) + led[at - back]]
            known = after >= 0 if going is None else (after >= 0) & going
            state = np.where(known, after, state)
            going = known
        place = state * np.int32(self.symbols) + self.symbol[data]
        full = np.flatnonzero(lengths)
        begin = offsets[:-1][full]
        for k in range(len(self.langs)):
            total[full, k] = np.add.reduceat(self.cost[:, k][place].astype(np.float64), begin)
        return total


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits the trees on labelled rows that aren't held out, about ``per_language`` of each language."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    many = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).count().withColumnRenamed("count", "n").collect()}
    if not many:
        return Model([])
    if len(many) > MOST_LANGUAGES:
        raise ValueError(f"{len(many)} languages; {MOST_LANGUAGES} at most")
    rate = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, per_language / n))])[F.col(lang_col)]
    drawn = rows.filter((F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)) < rate)
    counts = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(tk.released(_grams), "lang string, gram long, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    model = Model(table)
    del table
    tk._release()
    return model


def has_letter(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script; a null has none."""
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch, "text", 1 << 19):
                texts = batch.column("text").slice(a, b - a)
                lengths = np.diff(offsets)
                letters = has_letter(texts)
                if model.langs:
                    bits = model.bits(data, offsets)
                    best = bits.argmin(axis=1)
                    low = bits[np.arange(b - a), best]
                    with np.errstate(under="ignore"):
                        score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                    pred = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    score = np.where(letters, score, 0.0)
                    per = low / np.maximum(lengths, 1)
                else:
                    pred, score, per = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(pred, pa.string()), pa.array(score), pa.array(per)], schema=_OUT)

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) of every row. The model, of MODEL_BYTES and the automaton at most, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tk.released(_score(shared)), OUT)


#: A text whose best code is longer than 8 bits a byte, the text itself, by more than REJECT_SLACK bits isn't of any language learned. The
#: slack is what naming the language and starting from nothing may cost; a short text is rarely so far from all of them.
REJECT_BITS, REJECT_SLACK = 8.0, 256.0


def accepted(docs: DataFrame, model: Model, text_col: str = "text", reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, data, offsets in tk.chunks(batch, text_col, 1 << 19):
                letters = has_letter(batch.column(text_col).slice(a, b - a))
                if model.langs:
                    keep[a:b] = letters & (model.bits(data, offsets).min(axis=1) <= reject_bits * np.diff(offsets) + REJECT_SLACK)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tk.released(run), docs.schema)
