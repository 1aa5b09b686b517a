"""Byte-level BPE with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be joined by a merge,
so a cut between them is certain.  Texts are cut there, the fragments are encoded independently (each
distinct fragment once, many fragments at a time in numpy), and the ids are concatenated.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_in, id_out, thrifty

#: Unicode white space as the tokenizer's pattern sees it.
WIDE_SPACES = tuple(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WHITE = "\\t-\\r " + "".join(WIDE_SPACES)
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Bytes that remembered fragments may take; beyond that, and at the end of a task, the memory starts anew.
REMEMBER = 24 << 20
#: What a remembered fragment takes besides its bytes and ids, and the longest that is worth it.
ENTRY, WORTH = 160, 256
#: Bytes of text whose fragments are encoded together.
TOGETHER = 1 << 21
#: Pieces above this many bytes are merged with a heap instead of in numpy rounds.
LONG = 96


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        size = len(self.token_bytes)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = size
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.merged = keys[order], order.astype(np.int64), joined
        self.none = len(pairs)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys.tolist())))}
        self.decimal = [str(i) for i in range(size)]
        self.cut = self._forced_cuts(token for i, token in enumerate(self.token_bytes) if i not in self.special.values())
        self.memory: dict[bytes, tuple[int, ...]] = {}
        self.sizes: dict[bytes, int] = {}
        self.short_keys, self.short_sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.held = 0  # bytes that these take

    @staticmethod
    def _forced_cuts(tokens: Iterable[bytes]) -> np.ndarray:
        """Table over byte pairs: True where a cut is certain for merges and for the piece pattern alike.

        The pattern is safe when the left byte ends a character that is no white space (whose runs look
        ahead) and the right one starts a character and is no apostrophe (which could open a
        contraction): both sides then match as they do in the whole text.  So the left byte is visible
        ASCII, or one of 0x80 and up that ends no Unicode space; a lead byte has no start after it.
        """
        inside = np.zeros(65_536, bool)
        for token in tokens:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int64)
                inside[b[:-1] * 256 + b[1:]] = True
        a, b = np.divmod(np.arange(65_536), 256)
        ends_space = np.isin(a, [c.encode()[-1] for c in WIDE_SPACES])
        return ~inside & (a > 0x20) & (a != 0x7F) & ~ends_space & ((b < 0x80) | (b >= 0xC0)) & (b != 0x27)

    def fragments(self, text: bytes) -> list[bytes]:
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, np.uint8)
        cuts = (np.flatnonzero(self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1).tolist()
        return [text[s:e] for s, e in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def _merge_long(self, piece: bytes) -> list[int]:
        """One piece by a heap of (rank, position), in n log n."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and (r := self.rank_of.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(len(ids)):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [i for i in ids if i >= 0]

    def merge_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces, and the offset at which each piece starts (one more at the end)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done_ids, done_owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(lengths > LONG).tolist():
            own = np.array(self._merge_long(pieces[k]), np.int64)
            done_ids.append(own)
            done_owner.append(np.full(len(own), k))
        short = lengths <= LONG
        owner = np.repeat(np.flatnonzero(short), lengths[short])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces if short.all() else [p for p in pieces if len(p) <= LONG]), np.uint8)]
        rank = np.full(len(ids), self.none, np.int64)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        rank[pair] = self._ranks(ids[pair], ids[pair + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), starts)
            over = (best >> 32) == self.none
            best &= 0xFFFFFFFF
            if over.any():  # these pieces have no merge left
                gone = np.repeat(over, np.diff(np.r_[starts, len(ids)]))
                done_ids.append(ids[gone])
                done_owner.append(owner[gone])
                stay = ~gone
                best = (np.cumsum(stay) - 1)[best[~over]]
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
            ids[best] = self.merged[rank[best]]
            keep = np.ones(len(ids), bool)
            keep[best + 1] = False
            at = (np.cumsum(keep) - 1)[best]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[at] = self.none
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(ids)]
                left = left[owner[left] == owner[left + 1]]
                rank[left] = self._ranks(ids[left], ids[left + 1])
        flat, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return flat[np.argsort(owner, kind="stable")], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(pieces)))]

    def _merge_fragments(self, wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all fragments, and the offset at which each fragment starts (one more at the end)."""
        pieces, starts = [], [0]
        for fragment in wanted:
            if (word := fragment.decode()).isalpha() or word[0] == " " and word[1:].isalpha():
                pieces.append(fragment)
            else:
                pieces += [p.encode() for p in PIECES.findall(word)]
            starts.append(len(pieces))
        flat, offsets = self.merge_pieces(pieces)
        return flat, offsets[starts]

    def _learn(self, wanted: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of the fragments; those worth it are remembered."""
        flat, offsets = self._merge_fragments(wanted)
        flat, offsets = flat.tolist(), offsets.tolist()
        new = dict(zip(wanted, [tuple(flat[s:e]) for s, e in zip(offsets, offsets[1:], strict=False)], strict=True))
        kept = {p: ids for p, ids in new.items() if len(p) <= WORTH} if max(map(len, wanted), default=0) > WORTH else new
        self.memory.update(kept)
        self.held += len(kept) * ENTRY + sum(map(len, kept)) + 8 * sum(map(len, kept.values()))
        return new

    def count_batch(self, texts: Iterable[str | None]) -> Iterator[int]:
        """The number of tokens of each text, as ordinary text."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append((text or "").encode("utf-8", "replace"))
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._counts(held)
                held, size = [], 0
        yield from self._counts(held)

    def _counts(self, texts: list[bytes]) -> list[int]:
        """Token numbers of the texts, whose fragments are looked up together.

        A fragment of up to seven bytes is its own key, bytes and length in one integer, so that these,
        the most by far, are sorted and looked up in numpy; Python sees only the new ones and longer ones.
        """
        text = b"".join(texts)
        if not text:
            return [0] * len(texts)
        if self.held > REMEMBER:
            self.forget()
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        b = np.frombuffer(text, np.uint8)
        start = np.zeros(len(b) + 1, bool)
        start[1:-1] = self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        start[bounds] = True
        starts = np.flatnonzero(start[:-1])
        lengths = np.diff(starts, append=len(b))
        short = lengths <= 7
        words = np.ndarray((len(b),), "<u8", text + bytes(8), 0, (1,))  # the eight bytes from each place on
        n = lengths[short].astype(np.uint64)
        keys = (words[starts[short]] & ((np.uint64(1) << (n << np.uint64(3))) - np.uint64(1))) | (n << np.uint64(56))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        distinct = keys[first]
        at = np.searchsorted(self.short_keys, distinct)
        absent = np.r_[self.short_keys, np.uint64(0)][at] != distinct
        fresh, raw = distinct[absent], distinct[absent].tobytes()
        parts = [text[s:e] for s, e in zip(starts[~short].tolist(), (starts + lengths)[~short].tolist(), strict=True)]
        new = list(set(parts).difference(self.sizes))
        wanted = [raw[8 * i : 8 * i + k] for i, k in enumerate((fresh >> np.uint64(56)).tolist())] + new
        found = np.diff(self._merge_fragments(wanted)[1]) if wanted else np.zeros(0, np.int64)
        self.short_keys = np.insert(self.short_keys, at[absent], fresh)
        self.short_sizes = np.insert(self.short_sizes, at[absent], found[: len(fresh)])
        self.sizes.update(zip(new, found[len(fresh) :].tolist(), strict=True))
        tokens = np.empty(len(starts), np.int64)
        tokens[~short] = np.fromiter(map(self.sizes.__getitem__, parts), np.int64, len(parts))
        sizes = self.short_sizes[np.searchsorted(self.short_keys, distinct)]
        tokens[np.flatnonzero(short)[order]] = sizes[np.cumsum(first) - 1]
        for p in new:
            if len(p) > WORTH:
                del self.sizes[p]
            else:
                self.held += ENTRY + len(p)
        self.held += 9 * len(fresh)
        return np.diff(np.r_[0, np.cumsum(tokens)][np.searchsorted(starts, bounds)]).tolist()

    def forget(self) -> None:
        """Gives the memory back: Python workers live on after a task and may next run something else."""
        self.memory.clear()
        self.sizes.clear()
        self.short_keys, self.short_sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.held = 0

    def _segments(self, text: str, special: bool) -> list[bytes | int]:
        if special and self.special_split and any(t in text for t in self.special):
            return [self.special[s] if s in self.special else s.encode() for s in self.special_split.split(text) if s]
        return [text.encode()] if text else []

    def encode_batch(self, texts: Iterable[str | None], special: bool = True) -> Iterator[list[tuple[int, ...]]]:
        """For each text the id tuples of its fragments, in order.

        special: strings of special tokens in a text become their ids; else they are ordinary text.
        """
        held: list[list] = []
        size = 0
        for text in texts:
            parts: list = []
            for segment in self._segments((text or "").encode("utf-8", "replace").decode(), special):
                parts += [(segment,)] if isinstance(segment, int) else self.fragments(segment)
            held.append(parts)
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._resolve(held)
                held, size = [], 0
        yield from self._resolve(held)

    def _resolve(self, held: list[list]) -> Iterator[list[tuple[int, ...]]]:
        if self.held > REMEMBER:
            self.forget()
        collecting = gc.isenabled()
        gc.disable()  # many small tuples without cycles are made here
        known = self.memory.get
        found = [list(map(known, parts)) for parts in held]
        gaps = [(parts, got, [i for i, g in enumerate(got) if g is None]) for parts, got in zip(held, found, strict=True) if None in got]
        fresh = self._learn(list({p for parts, _, at in gaps for i in at if type(p := parts[i]) is bytes}))
        for parts, got, at in gaps:
            for i in at:
                got[i] = fresh[p] if type(p := parts[i]) is bytes else p
        if collecting:
            gc.enable()
        yield from found

    def encode(self, text: str | None, special: bool = True) -> list[int]:
        return list(chain.from_iterable(next(self.encode_batch([text], special))))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD.  Ids outside the vocabulary are skipped."""
        table = self.token_bytes
        return b"".join([table[i] for i in ids if 0 <= i < len(table)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) for every row; null text gives an empty array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer)
        for batch in batches:
            ids = [np.fromiter(chain.from_iterable(parts), np.int32) for parts in bpe.encode_batch(batch["text"], special)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})
        bpe.forget()

    return id_out(df.select(id_in(id_col), F.col(text_col).alias("text")).mapInPandas(thrifty(run), "doc_id long, ids array<int>"))


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; a null array gives an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [bpe.decode(i if i is not None else ()) for i in batch["ids"]]})

    return id_out(df.select(id_in(id_col), F.col(ids_col).alias("ids")).mapInPandas(thrifty(run), "doc_id long, text string"))


def token_lengths(df: DataFrame, tokenizer: str, text_col: str = "text", name: str = "n_tokens", keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns and the number of tokens of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer)
        for batch in batches:
            yield batch[list(keep)].assign(**{name: list(bpe.count_batch(batch["_text"]))})
        bpe.forget()

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + f", `{name}` long"
    return df.select(*keep, F.col(text_col).alias("_text")).mapInPandas(thrifty(run), schema)


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty; its ids and its decoded text are empty.  Repeated rows are returned as
    often as they come, a null id stays null, and an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer)
        sha, decimal = hashlib.sha256, bpe.decimal
        for batch in batches:
            rows = []
            for parts in bpe.encode_batch(batch["text"]):
                ids = list(chain.from_iterable(parts))
                written = ",".join([decimal[i] for i in ids]).encode()
                rows.append((len(ids), sha(written).hexdigest(), sha(bpe.decode(ids).encode()).hexdigest()))
            if not rows:
                continue
            n, a, b = zip(*rows, strict=True)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})
        bpe.forget()

    picked = df.select(id_in(id_col), F.col(text_col).alias("text"))
    return id_out(picked.mapInPandas(thrifty(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
