"""Language identification by cross-parsing entropy.

For every label a suffix automaton of a bounded sample of labelled text accepts all
its substrings. A text is parsed greedily into longest matches ("phrases") against each
label; the label needing fewest phrases per symbol wins. Every phrase is charged the same, whatever the
length of the label's sample, so a label learned from a few symbols never is cheap: its matches are short.
Missing transitions are compiled to "end the phrase, begin the next one from the
root", so a parse is one table lookup per symbol, done by numpy for many blocks of text
and all labels at once. Whole texts are parsed, in blocks of BLOCK symbols that each
begin a new phrase; texts are taken from Arrow by bytes, so one very long text is alone in its pass.

No label is left out: samples get shorter as labels get more (256 symbols at least), and the
table grows by at most half a megabyte a label.

Defined results: null and empty texts and texts without a letter are ``und``; ties go to the first
name; repeated rows get equal results; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small_or_shuffle, ship_code, spread_tasks, stored, text_slices

#: Symbols parsed from the root at a time, and symbols times labels handled by one numpy pass.
BLOCK, PASS_SYMBOLS = 256, 1 << 21


@dataclass(frozen=True)
class LangConfig:
    """Bounds of the labelled sample the model is fitted on; nothing else is sampled."""

    rows: int = 512            # labelled rows per label at most, in the order of a hash
    excerpt_chars: int = 128   # taken from each of them
    model_chars: int = 16384   # symbols per label; less when labels are many
    total_chars: int = 262144  # symbols of all labels, unless 256 for each are more
    apart: int = 8             # every so many rows of a label are not learned but tell its usual phrase rate

    def bound(self, labels: int) -> int:
        """Symbols per label."""
        return max(256, min(self.model_chars, self.total_chars // max(1, labels)))

    def picks(self, labels: int) -> int:
        """Rows per label."""
        return min(self.rows, max(4 * self.apart, 4 * self.bound(labels) // self.excerpt_chars))


# ---------------------------------------------------------------- symbols

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Over all code points: is it a letter?"""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


#: Symbol 0 pads blocks, 1 is a run of non-letters, from 2 on come those that the rarer letters share: one if the samples
#: have no such letter, as then it always is a phrase of its own, 32 otherwise. The frequent letters' own symbols follow.
PAD, GAP, SHARED = 0, 1, 2
SHARES, FREQUENT = 32, 200


def symbol_table(samples: list[np.ndarray]) -> np.ndarray:
    """Code point -> symbol: the up to 200 most frequent letters of the samples have their own."""
    table = np.full(0x110000, GAP, dtype=np.uint8)
    every = letters()
    where = np.flatnonzero(every)
    seen = Counter(c for s in samples for c in s.tolist() if every[c])
    shares = SHARES if len(seen) > FREQUENT else 1
    table[where] = SHARED + where % shares
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]):
        table[c] = SHARED + shares + i
    return table


def symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of non-letters folded into one."""
    s = table[points]
    if len(s) > 1:
        s = s[np.concatenate(([True], (s[1:] != GAP) | (s[:-1] != GAP)))]
    return s


# ---------------------------------------------------------------- suffix automaton

def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def parse_table(step: list[dict[int, int]], width: int, base: int) -> np.ndarray:
    """Flat table over (state, symbol): four times the row start of the next state plus the phrases that end.

    A symbol that no transition takes ends the phrase; if it begins no other either, it is a phrase
    of its own. ``base`` is the first state of this automaton in the common table.
    """
    root = np.full(width, base * width * 4 + 2, dtype=np.int64)
    for c, q in step[0].items():
        root[c] = (base + q) * width * 4 + 1
    table = np.repeat(root[None, :], len(step), axis=0)
    table[0][root == base * width * 4 + 2] -= 1  # at the root no phrase is in progress
    for s, out in enumerate(step):
        for c, q in out.items():
            table[s, c] = (base + q) * width * 4
    table[:, PAD] = (base + np.arange(len(step))) * width * 4
    return table.ravel()


class Model:
    """Automata of all labels in one table, and the largest phrase rate of each label's rows kept apart."""

    def __init__(self, samples: dict[str, str], total_chars: int, model_chars: int, apart: dict[str, list[str]] | None = None):
        names = sorted(samples)
        bound = LangConfig(model_chars=model_chars, total_chars=total_chars).bound(len(names))
        points = [code_points(samples[n]) for n in names]
        self.table = symbol_table(points)
        parts = [symbols(p, self.table)[:bound] for p in points]
        keep = [i for i, p in enumerate(parts) if (p != GAP).any()]
        self.names = [names[i] for i in keep]
        self.width = int(self.table.max()) + 1
        tables, starts, base = [], [], 0
        for i in keep:
            step = suffix_automaton(parts[i].tolist())
            tables.append(parse_table(step, self.width, base))
            starts.append(base * self.width)
            base += len(step)
        number = np.int32 if base * self.width < 1 << 28 else np.int64
        self.next = np.concatenate([t.astype(number) for t in tables]) if tables else np.empty(0, number)
        self.starts = np.array(starts, dtype=number)
        self.usual = np.full(len(keep), np.nan)
        for i, n in enumerate(self.names):
            own = [s for s in (symbols(code_points(t), self.table) for t in (apart or {}).get(n, [])) if (s != GAP).any()]
            if own:
                self.usual[i] = max(c[i] / len(s) for c, s in zip(self.phrases(own), own, strict=True))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language) number of phrases of the symbol arrays."""
        blocks = np.array([-(-len(t) // BLOCK) for t in texts], dtype=np.int64)
        n = int(blocks.sum())
        grid = np.zeros((n, BLOCK), dtype=np.uint8)
        flat, at = grid.ravel(), 0
        for t, b in zip(texts, blocks, strict=True):
            flat[at: at + len(t)] = t
            at += b * BLOCK
        count = np.zeros((len(self.names), n), dtype=np.int32)
        if n:
            columns = np.ascontiguousarray(grid.T).astype(self.next.dtype)
            state = np.repeat(self.starts[:, None], n, axis=1)  # one row per label
            value = np.empty_like(state)
            for c in columns:
                state += c
                np.take(self.next, state, out=value, mode="clip")
                count += value & 3
                np.right_shift(value, 2, out=state)
            count += state != self.starts[:, None]  # the phrase in progress at the end of a block
        owner = np.repeat(np.arange(len(texts)), blocks)
        return np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count], axis=1) \
            if len(self.names) else np.zeros((len(texts), 0))

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, int]]:
        """(label, score, phrases per symbol of the winner, symbols) of every text."""
        out, group, size = [("und", 0.0, 1.0, 0)] * len(texts), [], 0
        for i, t in enumerate(texts):
            s = symbols(code_points(t), self.table) if t else np.empty(0, np.uint8)
            if self.names and len(s) and (s != GAP).any():
                if group and size + len(s) > PASS_SYMBOLS // len(self.names):
                    self._predict(group, out)
                    group, size = [], 0
                group.append((i, s))
                size += len(s) + BLOCK
        if group:
            self._predict(group, out)
        return out

    def _predict(self, group, out) -> None:
        count = self.phrases([s for _, s in group])
        best = count.argmin(axis=1)  # a tie goes to the first name in order
        for (i, s), b, row in zip(group, best.tolist(), count, strict=True):
            rest = np.delete(row, b)
            score = 1.0 if not len(rest) else float(1 - row[b] / rest.min())
            out[i] = (self.names[b], score, min(1.0, float(row[b]) / len(s)), len(s))

    def foreign(self, label: str, rate: float, n: int, max_rate: float) -> bool:
        """Is a text of n symbols in none of the labels' languages? Its best label's phrases would have to be more
        than one above ``max_rate`` and above 5/4 of the largest rate of rows of that label kept apart; a
        label too small to have any such row rejects nothing."""
        usual = self.usual[self.names.index(label)]
        return not np.isnan(usual) and rate * n > max(max_rate, 1.25 * usual) * n + 1


# ---------------------------------------------------------------- Spark jobs

def held_out(id_col: str):
    """Rows whose label is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, config: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Fit on excerpts of a bounded number of labelled rows that are not held out.

    The rows per label are the first by a hash of id and text. A threshold on the hash, from the
    label's count, leaves about four times as many for the row numbers, however many rows a
    label has, and its first row always; the excerpts (bounded by the configuration) come to the driver.
    """
    text = F.col(text_col)
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & text.isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "languages")
    labels = counts.count()
    if not labels:
        return Model({}, config.total_chars, config.model_chars)
    picks = config.picks(labels)
    share = F.lit(4.0 * picks) / F.col("n")
    limit = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0 ** 64 - 2.0 ** 63).cast("long"))
    most = counts.select("lang", F.greatest(limit, "least").alias("limit"))
    room = F.greatest(F.length("text") - config.excerpt_chars, F.lit(0)) + 1
    at = (F.pmod(F.xxhash64("text"), room.cast("bigint")) + 1).cast("int")
    first = (join_small_or_shuffle(rows, most, "lang", "inner", labels, 128).where("h <= limit")
             .select("lang", "h", F.substr("text", at, F.lit(config.excerpt_chars)).alias("excerpt")))
    order = Window.partitionBy("lang").orderBy("h", "excerpt")
    picked = (first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= picks)
              .select("lang", "place", "excerpt").collect())
    samples: dict[str, dict[str, None]] = {}
    apart: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["place"])):
        if r["place"] % config.apart:
            samples.setdefault(r["lang"], {})[r["excerpt"]] = None  # equal texts give equal excerpts: once
        else:
            apart.setdefault(r["lang"], []).append(r["excerpt"])
    return Model({k: " ".join(v) for k, v in samples.items()}, config.total_chars, config.model_chars, apart)


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (1 - phrases of the best label / phrases of the second), phrase_rate.

    ``und`` with score 0 is also every text when nothing was learned.
    """
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = spread_tasks(docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")))

    def run(batches):
        for b in batches:
            at = 0
            for texts in text_slices(b.column(2)):
                lang, score, rate, _ = zip(*shared.value.predict(texts), strict=True)
                own = b.slice(at, len(texts)).columns[:2]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score", "phrase_rate"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, phrase_rate double")


def reject_foreign(docs: DataFrame, max_rate: float = 0.5, config: LangConfig = LangConfig(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, written in a learned language.

    Rejected are null texts, texts without letters and texts in none of the languages (``Model.foreign``); when
    nothing was learned all texts are ``und`` and go. Rows are filtered in the worker that reads them.
    """
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, config, text_col=text_col))
    rows, at = spread_tasks(docs), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            first = 0
            for texts in text_slices(b.column(at)):
                model = shared.value
                keep = [lang != "und" and not model.foreign(lang, rate, n, max_rate) for lang, _, rate, n in model.predict(texts)]
                yield b.slice(first, len(texts)).filter(pa.array(keep, pa.bool_()))
                first += len(texts)

    return rows.mapInArrow(run, ", ".join(f"{_column(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields))
