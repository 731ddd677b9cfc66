"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end the
prefix's encoding: the one that is compatible with the last token of the prefix
before it. ``PrefixBpe.extend`` stores that token for each prefix, so bytes can be
appended without encoding anew, and ``PrefixBpe.edit`` re-encodes only from an edit
until the stored tokens agree with the old ones over a whole token length.

Two tokens are compatible if merging their bytes by rank gives the two tokens
back; a sequence of pairwise compatible tokens is the rank-order encoding. Where
every token's last merge joins tokens of lower rank, as in trained vocabularies,
merges come in the order of their ranks, and two tokens are compatible if no pair
of parts along their border merges before both parts are used up: a few lookups
in the table of last merges instead of merging the bytes. From each position only
the tokens in a trie of the vocabulary that the text goes on with are tried.
``PrefixBpe.encode_many`` fills the tables of many short pieces together, position
by position.

Defined cases: null text is empty, empty text has no tokens (digests of no
bytes), texts of any length are encoded whole, rows and ids may repeat, other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame


CACHED_PIECES, CACHED_PAIRS = 300_000, 300_000
#: Longer pieces (bytes) are encoded one by one; texts are encoded together in chunks of about so many characters.
TOGETHER, CHUNK = 32, 1 << 21
#: Slots for answers about pairs, 8 bytes each; a new pair takes the place of the one in its slot.
PAIR_SLOTS = 1 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PrefixBpe:
    """Encoder for single pieces over fixed ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._grow()
        self._splits, self._joined = self._last_merges()
        self._arrays = None

    def _grow(self) -> None:
        """The trie, its rows laid over each other: with at = _base[node] + byte the next node is _next[at] if _owner[at] is node, else none.

        Only the nodes below _inner have next ones; _ends[node] is the token that ends there or -1.
        """
        inner = {b"": 0}
        for token in self.ranks:
            for at in range(1, len(token)):
                inner.setdefault(token[:at], len(inner))
        nodes = dict(inner)
        for token in self.ranks:
            nodes.setdefault(token, len(nodes))
        ends, kids = array("i", [-1]) * len(nodes), [[] for _ in inner]
        for token, rank in self.ranks.items():
            ends[nodes[token]] = rank
        for prefix, node in nodes.items():
            if prefix:
                kids[inner[prefix[:-1]]].append((prefix[-1], node))
        base, owner, after = array("i", [0]) * len(inner), array("i", [-1]) * 512, array("i", [-1]) * 512
        at = free = 256
        for node in sorted(range(len(inner)), key=lambda i: -len(kids[i])):
            row = kids[node]
            if len(row) == 1:  # these come last and fill the holes
                while free < len(owner) and owner[free] >= 0:
                    free += 1
                at = free - row[0][0]
            else:
                while any(owner[at + byte] >= 0 for byte, _ in row):
                    at += 1
                    if len(owner) < at + 256:
                        owner.extend([-1] * 4096)
                        after.extend([-1] * 4096)
            if len(owner) < at + 512:
                owner.extend([-1] * 4096)
                after.extend([-1] * 4096)
            base[node] = at
            for byte, kid in row:
                owner[at + byte], after[at + byte] = node, kid
        self._base, self._owner, self._next, self._ends, self._inner = base, owner, after, ends, len(inner)

    def _last_merges(self) -> tuple[dict[int, tuple[int, int]] | None, dict[int, int]]:
        """Token to the two tokens that its last merge joins, and those two to it; None unless both have lower ranks for every token."""
        splits, joined = {}, {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self.merged(token, 2)
                if len(parts) != 2 or max(parts) >= rank:
                    return None, {}
                splits[rank] = parts[0], parts[1]
                joined[parts[0] << 32 | parts[1]] = rank
        return splits, joined

    def merged(self, piece: bytes, least: int = 1) -> list[int]:
        """The plain rank-order merge, for pieces of one or two tokens, until that many parts are left."""
        rank, none = self.ranks.get, 1 << 62
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether merges reach the token from its own bytes."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        if (known := self._pairs.get(left << 32 | right)) is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            if self._splits is None:
                known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            else:
                known = self._apart(left, right)
            self._pairs[left << 32 | right] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """compatible() by last merges: undoes the later merge of the two parts at the border until none is left to undo.

        The parts stood side by side before the merge undone last (before: its rank; of equal ranks the left one goes
        first). Had they a merge of their own by then, it would have crossed the border.
        """
        splits, joined, before = self._splits, self._joined, 1 << 62
        while True:
            if joined.get(left << 32 | right, before) < before:
                return False
            if left > right:
                split = splits.get(left)
                if split:
                    before, left = left, split[1]
                    continue
                split = splits.get(right)
                if not split:
                    return True
                before, right = right + 1, split[0]
            else:
                split = splits.get(right)
                if split:
                    before, right = right + 1, split[0]
                    continue
                split = splits.get(left)
                if not split:
                    return True
                before, left = left, split[1]

    def _last(self, text: bytes, last: list[int], end: int) -> int:
        rank, pairs = self.ranks.get, self._pairs
        for start in range(end - self.longest if end > self.longest else 0, end):
            token = rank(text[start:end])
            if token is None:
                continue
            if start:
                known = pairs.get(last[start] << 32 | token)
                if self.compatible(last[start], token) if known is None else known:
                    return token
            elif self.whole(token):
                return token
        raise ValueError("a byte has no token")

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """last[i]: the last token of text[:i]; grown in place from what it holds to the whole text."""
        if not last:
            last.append(-1)
        done, size, pairs = len(last), len(text), self._pairs
        base, owner, after, ends, inner = self._base, self._owner, self._next, self._ends, self._inner
        last += [-1] * (size + 1 - done)
        for start in range(max(0, done - self.longest), size):
            left, node, end = last[start], 0, start
            if start and left < 0:
                break
            while end < size and node < inner and owner[at := base[node] + text[end]] == node:
                node = after[at]
                token = ends[node]
                end += 1
                # smaller starts come first, so of the tokens that end here the longest is tried first
                if token < 0 or end < done or last[end] >= 0:
                    continue
                if start:
                    known = pairs.get(left << 32 | token)
                    if self.compatible(left, token) if known is None else known:
                        last[end] = token
                elif self.whole(token):
                    last[end] = token
        if size >= done and -1 in last[max(1, done - 1) :]:
            raise ValueError("a byte has no token")
        return last

    def edit(self, text: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """text with [start, stop) replaced by new, and its table; positions far behind the edit are reused."""
        changed, table = text[:start] + new + text[stop:], last[: start + 1]
        shift, same = len(new) - (stop - start), 0
        for end in range(start + 1, len(changed) + 1):
            table.append(self._last(changed, table, end))
            same = same + 1 if end > start + len(new) and table[end] == last[end - shift] else 0
            if same >= self.longest:
                return changed, table + last[end - shift + 1 :]
        return changed, table

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None and self.whole(token):
            return [token]
        return self.tokens(self.extend(piece, []))

    def _tables(self) -> dict[str, np.ndarray]:
        if self._arrays is None:
            top = max(self.bytes_of) + 1
            left, right, size = (np.full(top, -1, np.int64) for _ in range(3))
            for token, (a, b) in self._splits.items():
                left[token], right[token] = a, b
            size[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
            joined = np.array(sorted(self._joined.items()), np.int64).reshape(-1, 2)
            self._arrays = {
                "left": left, "right": right, "size": size, "pairs": joined[:, 0].copy(), "joined": joined[:, 1].copy(),
                "seen": np.full(PAIR_SLOTS, -1, np.int64),
            } | {name: np.frombuffer(of, np.int32) for name, of in (("base", self._base), ("owner", self._owner), ("next", self._next), ("ends", self._ends))}
        return self._arrays

    def _apart_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_apart() for many pairs."""
        t = self._tables()
        out, who, before = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(who):
            if len(t["pairs"]):
                key = left << 32 | right
                at = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
                merge = (t["pairs"][at] == key) & (t["joined"][at] < before)
                out[who[merge]] = False
            else:
                merge = np.zeros(len(who), bool)
            inner_left, inner_right = t["right"][left], t["left"][right]
            undo_left = (inner_left >= 0) & ((left > right) | (inner_right < 0))
            on = ~merge & (undo_left | (inner_right >= 0))
            before = np.where(undo_left, left, right + 1)[on]
            left, right, who = np.where(undo_left, inner_left, left)[on], np.where(undo_left, right, inner_right)[on], who[on]
        return out

    def _compatible_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        seen = self._tables()["seen"]
        key = left << 31 | right
        slot = ((key * 0x1E3779B97F4A7C15) >> 40) & (PAIR_SLOTS - 1)
        held = seen[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            out[new] = self._apart_many(left[new], right[new])
            seen[slot[new]] = key[new] << 1 | out[new]
        return out

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers; the tables of short pieces are filled together, from each position at once."""
        found: list = [None] * len(pieces)
        short = sorted((i for i, p in enumerate(pieces) if 0 < len(p) <= TOGETHER), key=lambda i: -len(pieces[i])) if self._splits is not None else []
        for at in range(0, len(short), 1 << 16):
            part = short[at : at + (1 << 16)]
            for i, ids in zip(part, self._encode_short([pieces[i] for i in part])):
                found[i] = ids
        return [array("I", self.encode(p)).tobytes() if ids is None else ids for p, ids in zip(pieces, found)]

    def _encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """pieces: longest first. last[i, p]: the last token of the first i bytes of piece p."""
        t = self._tables()
        base, owner, after, ends = t["base"], t["owner"], t["next"], t["ends"]
        sizes = np.array([len(p) for p in pieces])
        width, n = int(sizes[0]), len(pieces)
        rows = np.zeros((n, width), np.uint8)
        rows[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        text = np.ascontiguousarray(rows.T)
        longer = [int(x) for x in np.searchsorted(-sizes, -np.arange(width + 1))]  # longer[i]: how many pieces have more than i bytes
        last = np.full((width + 1, n), -1, np.int64)
        for start in range(width):
            who = np.arange(longer[start])
            if start and (last[start, who] < 0).any():
                raise ValueError("a byte has no token")
            node = np.zeros(len(who), np.int32)
            for end in range(start + 1, width + 1):
                fit = np.searchsorted(who, longer[end - 1])
                slot = base[node[:fit]] + text[end - 1, who[:fit]]
                on = np.flatnonzero(owner[slot] == node[:fit])
                who, node = who[on], after[slot[on]]
                if not len(who):
                    break
                token = ends[node]
                new = np.flatnonzero((token >= 0) & (last[end, who] < 0))
                at, token = who[new], token[new].astype(np.int64)
                if start and len(at):
                    ok = self._compatible_many(last[start, at], token)
                    at, token = at[ok], token[ok]
                last[end, at] = token
                on = np.flatnonzero(node < self._inner)
                who, node = who[on], node[on]
        if (last[sizes, np.arange(n)] < 0).any():
            raise ValueError("a byte has no token")
        ids, counts = np.zeros((n, width), "<u4"), np.zeros(n, np.int64)
        who, end = np.arange(n), sizes.copy()
        while len(who):
            token = last[end, who]
            counts[who] += 1
            ids[who, width - counts[who]] = token
            end = end - t["size"][token]
            on = end > 0
            who, end = who[on], end[on]
        flat = ids[np.arange(width) >= (width - counts)[:, None]].tobytes()
        stops = (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class _Pieces(dict):
    """Piece to its ids as little-endian 32-bit integers; holds CACHED_PIECES at most, half of them as the older ones, so that frequent pieces stay."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.older.get(piece)) is None:
            found = array("I", self.bpe.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            self._hold(piece, found)
        return found

    def _hold(self, piece: str, found: bytes) -> None:
        if len(self) >= CACHED_PIECES // 2:
            self.older = None  # freed before the copy
            self.older = dict(self)
            self.clear()
        self[piece] = found

    def learn(self, pieces: set[str]) -> None:
        """Encodes the short ones among them that are not held, together."""
        new = [p for p in pieces if p not in self and p not in self.older and len(p) <= TOGETHER][: CACHED_PIECES // 2]
        for piece, found in zip(new, self.bpe.encode_many([p.encode() for p in new])):
            self._hold(piece, found)


class Codec:
    """Splits a text by the pattern and encodes each match separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe = PrefixBpe(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.bpe)
        self.table = [self.bpe.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str) -> array:
        return self._ids(self.split(text))

    def _ids(self, pieces: list[str]) -> array:
        ids = array("I")
        ids.frombytes(b"".join(map(self.pieces.__getitem__, pieces)))
        return ids

    def encode_all(self, texts: Iterable[str]) -> Iterator[array]:
        """encode() of each text, in order; a chunk of texts learns its new pieces together."""
        held, size = [], 0
        for text in texts:
            held.append(self.split(text))
            size += len(text)
            if size >= CHUNK:
                yield from self._all_ids(held)
                held, size = [], 0
        yield from self._all_ids(held)

    def _all_ids(self, held: list[list[str]]) -> Iterator[array]:
        self.pieces.learn(set(chain.from_iterable(held)))
        return map(self._ids, held)

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def _codec(ranks, key: tuple[str, str, int], held: dict = {}) -> Codec:  # noqa: B006
    """A worker's codec: it and its pieces outlive the task. key: path of the ranks, pattern, number of ranks."""
    if held.get("key") != key:
        held.update(key=key, codec=Codec(ranks.value, key[1]))
    return held["codec"]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>) of every whole text. No shuffle."""
    table = load_ranks(ranks_path)
    ranks, key = docs.sparkSession.sparkContext.broadcast(table), (ranks_path, pattern, len(table))  # a vocabulary: fixed size
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(ranks, key)
        for batch in batches:
            n, ids_hash, decoded_hash, all_ids = [], [], [], []
            for ids in codec.encode_all(value.as_py() or "" for value in batch.column(1)):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array([list(x) for x in all_ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)
