"""BPE encoding and decoding: speculate and verify.

Speculate: greedy longest match over the vocabulary proposes tokens for
every new word.  Verify: a token sequence is the word's BPE encoding
exactly if every adjacent pair (a, b) is, that is, if merging the bytes
of a followed by b gives [a, b] back -- no merge across the border of a
and b may come before the merges that build a and b.  All adjacent pairs
of a batch are tested together by array operations.  Only the words that
fail are merged exactly.

Test of a pair: undo the merges of both sides from the latest to the
earliest.  At each moment the two tokens at the border are known; if the
merge table joins them with a rank lower than the merge that was just
undone, the border would not have survived.  When both sides are single
bytes, the border holds.

Defined results: null text counts as empty (no ids; digests of the empty
string); null or repeated doc_ids are kept row by row; an empty table
gives no rows; extra columns are never read.  No shuffle.  Memory per
task: one slice of texts and a word table that is emptied at a fixed
size; a text longer than a slice is encoded piece by piece, cut at proven
word boundaries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import only, text_or_empty
from tidemark.llm.pretoken import Encoder, Splitter, WordTable, byte_chars

NEVER = np.int64(1 << 40)


class MergeTable:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.id_of = {to_bytes(s): i for s, i in model["vocab"].items()}
        n = max([*self.id_of.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * n
        for s, i in self.id_of.items():
            self.bytes_of[i] = s
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.prefix = {s[:k]: -1 for s in self.id_of for k in range(1, len(s))} | self.id_of
        self.left = np.full(n, -1, np.int64)               # the two sides of the merge that makes a token
        self.right = np.full(n, -1, np.int64)
        self.made_at = np.full(n, -1, np.int64)            # that merge's rank; -1: a single byte
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = to_bytes(a), to_bytes(b)
            i, j, k = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.merge[i, j] = (rank, k)
            if self.made_at[k] < 0:
                self.left[k], self.right[k], self.made_at[k] = i, j, rank
        keys = np.fromiter(((i << 32) | j for i, j in self.merge), np.int64, len(self.merge))
        ranks = np.fromiter((r for r, _ in self.merge.values()), np.int64, len(self.merge))
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], ranks[order]
        self._stands = bytearray(n)                        # 1: known to stand alone

    def exact(self, word: bytes) -> list[int]:
        """Merge in rank order, leftmost first among equal ranks."""
        ids = [self.id_of[word[i:i + 1]] for i in range(len(word))]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Scan for the lowest rank; quickest for the usual word."""
        find, none = self.merge.get, (1 << 40, -1)
        pairs = [find(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i:i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Heap over a linked list; near linear in the word's length."""
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue                                    # one of the two is gone
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t >= 0]

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes encode to the token alone."""
        if not self._stands[token] and self.exact(self.bytes_of[token]) == [token]:
            self._stands[token] = 1
        return bool(self._stands[token])

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left, over tokens that stand.

        Walks each match forward through the vocabulary's prefixes, so a
        step that leads nowhere ends it."""
        out, i, n, find, sure = [], 0, len(word), self.prefix.get, self._stands
        while i < n:
            j = i + 1
            end, token = j, find(word[i:j])
            while j < n:
                j += 1
                t = find(word[i:j])
                if t is None:
                    break
                if t >= 0 and (sure[t] or self.stands(t)):
                    end, token = j, t
            out.append(token)
            i = end
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens that stand: does the border between them survive?"""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        undone = np.full(len(a), NEVER)                     # rank of the merge undone last
        undone_left = np.zeros(len(a), bool)                # ... was it on the left side?
        while len(live):
            rank = self._rank(a, b)
            # a merge across the border wins if it ranks lower; a merge of equal
            # rank wins where it lies further left, which is when the one undone
            # lies on the right side
            wins = (rank < undone) | ((rank == undone) & (rank < NEVER) & ~undone_left)
            ok[live[wins]] = False
            ra, rb = self.made_at[a], self.made_at[b]
            # undo the later merge; of equal ranks the right one happened later
            go_left = ra > rb
            keep = ~wins & ((ra >= 0) | (rb >= 0))
            a, b, live, go_left, ra, rb = (x[keep] for x in (a, b, live, go_left, ra, rb))
            undone = np.where(go_left, ra, rb)
            undone_left = go_left
            a, b = np.where(go_left, self.right[a], a), np.where(go_left, b, self.left[b])
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """(ids of each word, how many words needed exact merging)."""
        ids = [self.greedy(w) for w in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(ids)), n)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.unique(owner[inner][bad[which]])
        for k in failing.tolist():
            ids[k] = self.exact(words[k])
        return ids, len(failing)


class SpeculativeTable(WordTable):
    """A word table that encodes all new words of a batch together."""

    def __init__(self, merges: MergeTable, specials: dict[str, int], max_words: int):
        super().__init__(lambda w: self.new[w], max_words)
        self.merges, self.specials, self.new = merges, specials, {}

    def rows(self, joined: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self) >= self.max_words:
            self._reset()
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        fresh = [w for w in set(words) if w not in self]
        plain = [w for w in fresh if w not in self.specials]
        ids, _ = self.merges.encode_words([w.encode() for w in plain])
        self.new = dict(zip(plain, ids)) | {w: [i] for w, i in self.specials.items()}
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.new = {}
        return out


class SpeculativeEncoder(Encoder):
    """Encoder whose words are proposed greedily and verified pair by pair."""

    def __init__(self, path: str, batch_chars: int = 2_000_000, max_words: int = 250_000):
        self.splitter = Splitter(path)
        self.merges = MergeTable(path)
        self.table = SpeculativeTable(self.merges, self.splitter.specials, max_words)
        self.batch_chars = batch_chars


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the decoded text and
    the ids, ``with_text``) for every row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_text:
        schema += ", ids array<long>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpeculativeEncoder(tokenizer)
        decimal = [str(i) for i in range(len(encoder.merges.bytes_of))]
        piece = encoder.merges.bytes_of
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for ids, off in encoder.encode(batch.column(1).to_pylist()):
                out = {"n": [], "h": [], "d": [], "ids": [], "text": []}
                flat, edge = ids.tolist(), off.tolist()
                for a, b in zip(edge[:-1], edge[1:]):
                    own = flat[a:b]
                    text = b"".join([piece[i] for i in own]).decode("utf-8", "replace")
                    out["n"].append(b - a)
                    out["h"].append(hashlib.sha256(",".join([decimal[i] for i in own]).encode()).hexdigest())
                    out["d"].append(hashlib.sha256(text.encode()).hexdigest())
                    if with_text:
                        out["ids"].append(own)
                        out["text"].append(text)
                cols = {"doc_id": doc_ids.slice(at, len(edge) - 1), "n_tokens": pa.array(out["n"], pa.int64()),
                        "ids_sha256": pa.array(out["h"], pa.string()),
                        "decoded_sha256": pa.array(out["d"], pa.string())}
                if with_text:
                    cols |= {"ids": pa.array(out["ids"], pa.list_(pa.int64())),
                             "decoded": pa.array(out["text"], pa.string())}
                yield pa.RecordBatch.from_pydict(cols)
                at += len(edge) - 1

    return (only(docs, id=id_col, text=text_col)
            .select(F.col("id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(run, schema))
