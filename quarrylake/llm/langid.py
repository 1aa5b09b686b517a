"""Language identification by prediction by partial matching (PPM, escape method C).

Each language has counts in a byte context tree of variable order.  The trees share one set of
contexts, so they are walked by one automaton: its state is the longest context in the set that the
text just read ends in, and frozen tables hold the exact code length of every next byte in every
language.  The tables are sparse: a byte that no language has seen after a context points at the row
of the nearest shorter context that has it, and at the escapes on the way there.  A document's code
length is summed over all its bytes; texts are cut into segments that are walked side by side, and
each segment first reads the few bytes before it, after which its state is the one that a walk from
the start would have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_in, id_out, thrifty

#: Longest context in bytes, contexts of the automaton, and how often a context must have been seen.
ORDER, CONTEXTS, SEEN = 4, 8192, 4
#: Labelled documents of each language that the trees are fitted on at most, and bytes of them together.
SAMPLE, SAMPLE_BYTES = 400, 4 << 20
SEGMENT = 512
LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    order: int
    following: np.ndarray  # [state * 256 + byte] -> state
    row: np.ndarray  # [state * 256 + byte] -> row of ``bits``
    way: np.ndarray  # [state * 256 + byte] -> row of ``escapes``
    bits: np.ndarray  # [row, language] code length of a byte after the context that has it
    escapes: np.ndarray  # [way, language] code length of the escapes before that

    def bits_of(self, at: np.ndarray) -> np.ndarray:
        """Code lengths of [state * 256 + byte] in every language."""
        return self.bits[self.row[at]] + self.escapes[self.way[at]]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        pieces: list[tuple[int, int, int]] = []  # first byte to read, first byte to count, end
        owners, base = [], 0
        for k, t in enumerate(texts):
            for s in range(0, len(t), SEGMENT):
                pieces.append((base + max(0, s - self.order), base + s, base + min(s + SEGMENT, len(t))))
                owners.append(k)
            base += len(t)
        total = np.zeros((len(texts), len(self.languages)))
        if not pieces:
            return total
        data = np.frombuffer(b"".join(texts), np.uint8)
        start, count, end = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        order = np.argsort(start - end, kind="stable")  # longest first: those still active are a prefix
        start, count, end = start[order], count[order], end[order]
        sums = np.zeros((len(order), len(self.languages)), np.float64)
        state = np.zeros(len(order), np.int64)
        lengths = end - start
        for step in range(int(lengths[0])):
            m = int(np.searchsorted(-lengths, -step, side="left"))  # lengths > step
            at = state[:m] * 256 + data[start[:m] + step]
            if step < self.order:
                sums[:m] += self.bits_of(at) * (start[:m] + step >= count[:m])[:, None]
            else:
                sums[:m] += self.bits_of(at)
            state[:m] = self.following[at]
        np.add.at(total, np.array(owners)[order], sums)
        return total


def gram_counts(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each k up to ``order`` the distinct strings of k + 1 bytes, as numbers, and how often each occurs."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    place = np.concatenate([np.arange(len(t)) for t in texts]) if texts else np.zeros(0, np.int64)
    gram, out = data, []
    for k in range(order + 1):
        if k:
            gram = (gram[:-1] << np.uint64(8)) | data[k:]
        out.append(np.unique(gram[place[: len(gram)] + k < _ends(texts)[: len(gram)]], return_counts=True))
    return out


def _ends(texts: list[bytes]) -> np.ndarray:
    return np.repeat([len(t) for t in texts], [len(t) for t in texts]) if texts else np.zeros(0, np.int64)


def fit(samples: dict[str, list[str]], order: int = ORDER, contexts: int = CONTEXTS, seen: int = SEEN) -> LanguageModel:
    """Freezes the statistics of the labelled texts, language by language; every string counts, however rare."""
    languages = sorted(samples)
    width = len(languages)
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * (order + 1)
    for number, lang in enumerate(languages):
        for k, (gram, n) in enumerate(gram_counts([t.encode("utf-8", "replace") for t in samples[lang]], order)):
            grams[k] = tuple(np.concatenate(p) for p in zip(grams[k], (gram, np.full(len(gram), number), n), strict=True))
    totals = []  # (how often, length, context as a number)
    for k in range(1, order + 1):
        context, inverse = np.unique(grams[k][0] >> np.uint64(8), return_inverse=True)
        n = np.bincount(inverse, grams[k][2], len(context)).astype(np.int64)
        totals += zip((-n).tolist(), [k] * len(n), context.tolist(), strict=True)
    chosen = {(0, 0)}
    for n, k, context in sorted(t for t in totals if t[0] <= -seen):
        if len(chosen) >= contexts:
            break
        if (k - 1, context & ((1 << 8 * (k - 1)) - 1)) in chosen and (k - 1, context >> 8) in chosen:
            chosen.add((k, context))
    states = sorted(chosen)
    number_of = {c: i for i, c in enumerate(states)}
    parent = [number_of[k - 1, c & ((1 << 8 * (k - 1)) - 1)] if k else 0 for k, c in states]
    at, lang, many = [], [], []  # state * 256 + byte of every string after a chosen context
    for k, (gram, own, n) in enumerate(grams):
        held = np.array([c for length, c in states if length == k], np.uint64)
        place = np.minimum(np.searchsorted(held, gram >> np.uint64(8)), len(held) - 1)
        pick = np.flatnonzero(held[place] == gram >> np.uint64(8)) if len(held) else place[:0]
        at.append((place[pick] + number_of[k, int(held[0])]) * 256 + (gram[pick] & np.uint64(255)).astype(np.int64) if len(held) else pick)
        lang.append(own[pick])
        many.append(n[pick])
    cells, inverse = np.unique(np.concatenate(at), return_inverse=True)
    counts = np.zeros((len(cells), width))
    counts[inverse, np.concatenate(lang)] = np.concatenate(many)
    edges = np.searchsorted(cells, np.arange(len(states) + 1) * 256)
    row, way = np.zeros((len(states), 256), np.int32), np.zeros((len(states), 256), np.int32)
    bits = np.full((len(cells) + 1, width), 8.0)  # row 0: before any context all bytes are alike
    escapes = [np.zeros(width)]
    following = np.zeros((len(states), 256), np.int32)
    for i, (k, _) in enumerate(states):  # shorter contexts first
        c, seen_bytes = counts[edges[i] : edges[i + 1]], cells[edges[i] : edges[i + 1]] & 255
        total, kinds = c.sum(axis=0), (c > 0).sum(axis=0)
        escape = np.where(total > 0, kinds / np.maximum(1, total + kinds), 1.0)
        above_row, above_way = row[parent[i]].copy(), way[parent[i]].copy()  # zeros for the empty context
        ways, inverse = np.unique(above_way, return_inverse=True)  # one more escape than the parent's way to the same row
        row[i], way[i] = above_row, len(escapes) + inverse
        with np.errstate(divide="ignore"):
            escapes += [escapes[w] - np.log2(escape) for w in ways.tolist()]
            below = np.exp2(-bits[above_row[seen_bytes]] - np.array([escapes[w] for w in above_way[seen_bytes].tolist()]).reshape(c.shape) if k else np.full(c.shape, -8.0))
            bits[edges[i] + 1 : edges[i + 1] + 1] = -np.log2(np.where(c > 0, c / np.maximum(1, total + kinds), escape * below))
        row[i, seen_bytes], way[i, seen_bytes] = np.arange(edges[i], edges[i + 1]) + 1, 0
    for (k, context), i in number_of.items():
        if k:
            following[number_of[k - 1, context >> 8], context & 255] = i
    for i, (k, _) in enumerate(states):  # what goes on in no longer context goes on where the shorter one does
        if k:
            following[i] = np.where(following[i] > 0, following[i], following[parent[i]])
    return LanguageModel(languages, order, following.reshape(-1), row.reshape(-1), way.reshape(-1), bits.astype(np.float32), np.array(escapes, np.float32))


def training_sample(df: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample: int, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """At most ``sample`` whole texts of every language, in the order of a hash of the row, up to ``most_bytes``.

    A text of more than a quarter of ``most_bytes`` is not learned from.  Rows whose hash is beyond what a
    language needs for its sample are left on the map side, so no language is one task.  Equal rows have
    one hash; where they leave a language short, its rows are numbered.
    """
    picked = F.col(lang_col).alias("l"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    rows = df.filter(learn & F.col(lang_col).isNotNull())
    rows = rows.select(*picked, F.xxhash64(id_col, text_col).alias("h"), F.monotonically_increasing_id().alias("n")).filter(F.octet_length("t") <= most_bytes // 4)
    need = sample + 8 * sample**0.5 + 16
    many = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # a row for each language, as in the model

    def chosen(rows: DataFrame, languages: list[str]) -> dict[str, list[str]]:
        if not languages:
            return {}
        below = rows.sparkSession.createDataFrame([(lang, float(1 << 31) * min(1.0, need / many[lang])) for lang in languages], "l string, below double")
        few = rows.withColumn("h", F.shiftrightunsigned("h", 33)).join(F.broadcast(below), "l").filter("h <= below").select("l", "h", "t")
        order = Window.partitionBy("l").orderBy("h", "t")
        ranked = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample)
        ranked = ranked.withColumn("bytes", F.sum(F.octet_length("t").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        out: dict[str, list[str]] = {}
        for row in ranked.filter(F.col("bytes") <= most_bytes).orderBy("l", "r").collect():
            out.setdefault(row["l"], []).append(row["t"])
        return out

    found = chosen(rows, list(many))
    short = [lang for lang, n in many.items() if len(found.get(lang, ())) < min(sample, n) and sum(len(t.encode("utf-8", "replace")) for t in found.get(lang, ())) < most_bytes // 2]
    return found | chosen(rows.withColumn("h", F.xxhash64("h", "n")), short)


def identify(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (and ``keep``) for every row of ``df``.

    ``learn`` marks the rows whose text and language may be learned from; rows with a null language are
    never learned from.  Every language is learned, each from ``sample`` documents and SAMPLE_BYTES at
    most.  A text that is null, empty or without a letter is ``und`` with score 0, and so is every text
    where nothing could be learned.  Ties go to the language that sorts first.  The score is the chosen
    language's share of the likelihood, tempered to 64 bytes of text so that it stays graded for long
    ones.  Repeated rows are returned as often as they come; an empty table gives no rows.
    """
    samples = training_sample(df, learn, id_col, text_col, lang_col, sample)
    model = df.sparkSession.sparkContext.broadcast(fit(samples) if samples else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            lettered = [t is not None and LETTER.search(t) is not None for t in batch["_text"]]
            pred, score = ["und"] * len(batch), np.zeros(len(batch))
            at = [i for i, ok in enumerate(lettered) if ok and m is not None]
            texts = batch["_text"].tolist()
            while at:  # a few MB of text at a time
                some, size = [], 0
                while at and size < 2 << 20:
                    some.append(at.pop())
                    size += len(texts[some[-1]])
                raw = [texts[i].encode("utf-8", "replace") for i in some]
                bits = m.code_lengths(raw)
                best = bits.argmin(axis=1)
                gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, 64 / np.array([len(r) for r in raw]))[:, None]
                share = 1 / np.exp2(-gap).sum(axis=1)
                for i, b, s in zip(some, best.tolist(), share.tolist(), strict=True):
                    pred[i], score[i] = m.languages[b], s
            yield batch.drop(columns="_text").assign(lang_pred=pred, score=score)

    picked = df.select(id_in(id_col), *keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in picked.drop("_text").dtypes) + ", lang_pred string, score double"
    return id_out(picked.mapInPandas(thrifty(run), schema))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)), F.lit(0))
