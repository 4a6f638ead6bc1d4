"""Byte-level BPE of whole texts with a rank file, and its decoding, by higher-order functions on distinct words.

A task cuts its texts into the pattern's words and numbers the distinct ones; their bytes go to Spark by position.  Every stretch of a word's bytes that is a token is a
possible merge.  Higher-order functions find these with an automaton, whose tables are arrays of one row, by one step a byte; they fold over them in the order of their ranks and clear
the cuts between bytes, which are the bits of a long (of words of more than 62 bytes an array of booleans).  A merge takes effect where both its ends are still cuts; what stands between the
cuts that are left is looked up in the tables.

That equals merging the lowest pair again and again for every token that its own bytes reach by merges of rising rank: while
both ends of such a stretch are cuts nothing outside has an effect inside, so the stretch is at its
last pair when its rank's turn comes, and else it never is.  ``Ranks`` proves this for every token as it reads the file; with a file of which it does not hold, a fold merges the lowest pair of a
word again and again (``encode_pairwise``).
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import give_back, materialize, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Buckets of the literal rank map: a lookup searches one bucket's few entries.
BUCKETS = 1 << 14
#: Bytes of a word whose cuts are one long.
FOLDED = 62
#: Bytes of text cut into words at once, and distinct words that a task remembers before it starts anew.
SLICE, REMEMBERED = 2 << 20, 400_000


class Ranks:
    """Tokens by bytes, from a file of base64 token and rank a line.  ``odd`` holds the tokens that their own bytes do not reach by merges of rising rank."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.longest = max(map(len, self.ranks))
        self.odd = [t for t in self.ranks if len(t) > 1 and not self._reached(t)]

    def _reached(self, token: bytes) -> bool:
        ids, order = merged(token, self.ranks)
        return len(ids) == 1 and order == sorted(order) and order[-1] == self.ranks[token]

    def map_column(self) -> Column:
        """The rank map as a literal: an array of maps from a token's bytes to its rank, by the crc32 of the bytes."""
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for token, rank in self.ranks.items():
            buckets[zlib.crc32(token) % BUCKETS][token.hex()] = rank
        return F.transform(F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>"), lambda m: F.transform_keys(m, lambda k, _: F.unhex(k)))

    @property
    def pairwise(self) -> bool:
        """Whether words are merged pair by pair: tokens are odd, or more or longer than the packed numbers of ``Fold`` have bits for."""
        return bool(self.odd) or self.longest > FOLDED or max(self.ranks.values()) >= 1 << 20 or sum(map(len, self.ranks)) >= 1 << 20

    def lengths(self) -> np.ndarray:
        """The number of bytes of each id."""
        found = np.zeros(max(self.ranks.values()) + 1, np.int64)
        found[list(self.ranks.values())] = list(map(len, self.ranks))
        return found

    def pieces_column(self) -> Column:
        """The tokens' bytes in hexadecimal, by id, as a literal."""
        by_id = {rank: token.hex() for token, rank in self.ranks.items()}
        return F.from_json(F.lit(json.dumps([by_id.get(i) for i in range(max(by_id) + 1)])), "array<string>")


class Automaton:
    """Which tokens end at each byte of a word: a state is the longest stretch before it that begins a token.  Its tables are the arrays of one row.

    A state is a number: the place of its row above 20 bits, its own number below.  ``moves`` holds all rows, laid over one another: at the place of a row plus a byte stands
    the state behind that byte, with the row's place above 41 bits to tell whose it is.  Where a row has nothing the last two bytes alone decide (``after``).  ``ends`` has the tokens of 2 to 62 bytes that end in
    a state: the rank above 12 bits less 64 times the length, so that 65 times the place of the end makes it a possible merge.  ``ids`` has the tokens that end in a state by their length less one."""

    SCHEMA = "moves array<long>, after array<long>, ends array<array<long>>, ids array<array<int>>"

    def __init__(self, ranks: dict[bytes, int]):
        nodes = sorted({t[:i] for t in ranks for i in range(min(len(t), FOLDED) + 1)}, key=len)
        number = {n: i for i, n in enumerate(nodes)}
        below: list[dict[int, int]] = [{} for _ in nodes]
        for n, i in number.items():
            if n:
                below[number[n[:-1]]][n[-1]] = i
        rows: list[dict[int, int]] = []
        owner, ends, ids = [0] * len(nodes), [[] for _ in nodes], [[ranks.get(n)] if n else [] for n in nodes]
        for i, n in enumerate(nodes):
            if len(n) > 1:
                rest = n[1:]
                while rest not in number:
                    rest = rest[1:]
                f = number[rest]
                ends[i] = ends[f] + ([(ranks[n] << 12) - 64 * len(n)] if n in ranks else [])
                ids[i] = ids[f] + [None] * (len(n) - len(rest) - 1) + [ranks.get(n)]
                owner[i] = i if below[i] else owner[f]
                rows.append(rows[f] | below[i] if below[i] else rows[f])
            else:
                rows.append({})  # two bytes decide
        place, free, taken, tried, entries = {0: 0}, np.ones(1 << 23, bool), np.zeros(1 << 23, bool), 1, 0
        for i in sorted((i for i, o in enumerate(owner) if o == i and rows[i]), key=lambda i: -len(rows[i])):
            if len(rows[i]) != entries:
                entries, tried = len(rows[i]), 1  # smaller rows fit between larger ones
            held = np.fromiter(rows[i], np.int64)
            while True:
                fits = np.logical_and.reduce([~taken[tried : tried + 512], *(free[tried + c : tried + c + 512] for c in held.tolist())])
                if fits.any():
                    break
                tried += 512
            place[i] = at = tried + int(fits.argmax())
            free[at + held], taken[at] = False, True
            tried = at
        if max(place.values()) >= 1 << 21:
            raise ValueError("the file's tokens need more rows than a state has bits for")
        state = [place.get(o, 0) << 20 | i for i, o in enumerate(owner)]
        moves = np.full(max(place.values()) + 257, -1, np.int64)
        for i, at in place.items():
            for c, j in rows[i].items():
                moves[at + c] = at << 41 | state[j]
        single = [state[number.get(bytes([c]), 0)] for c in range(256)]
        pairs = [state[number[t]] if (t := bytes([b, c])) in number else single[c] for b in range(256) for c in range(256)] + single
        self.table = pa.table({"moves": pa.array([moves]), "after": pa.array([pairs], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.list_(pa.int64()))), "ids": pa.array([ids], pa.list_(pa.list_(pa.int32())))})


def merged(word: bytes, ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The ids of a word, and the ranks of its merges in order: the lowest pair first, of equal ones the leftmost, from a heap."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap, order = [], []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i >= 0 and j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        order.append(rank)
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]], order


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rank(ranks: Column, piece: Column) -> Column:
    return F.try_element_at(F.get(ranks, F.crc32(piece).bitwiseAND(BUCKETS - 1).cast("int")), piece)


def possible_merges(word: Column, ranks: Column, longest: int) -> Column:
    """The stretches of a word (binary) of at most 62 bytes that are tokens, by rank: each is one number of its rank, where it starts and where it stops."""
    n = F.octet_length(word)
    found = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 2, F.least(n, i + longest)), lambda j: F.shiftleft(_rank(ranks, word.substr(i + 1, j - i)).cast("long"), 12).bitwiseOR(F.shiftleft(i, 6)).bitwiseOR(j)))
    return F.when((n >= 2) & (n <= FOLDED), F.sort_array(F.filter(F.flatten(found), lambda c: c.isNotNull()))).otherwise(F.array().cast("array<long>"))


def encode_word(word: Column, merges: Column, ranks: Column) -> Column:
    """The ids of one word of 1 to 62 bytes (binary) from its possible merges, null for a longer one; ranks is ``Ranks.map_column``, bound by the caller."""
    n, one = F.octet_length(word), F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i)

    def merge(cuts: Column, c: Column) -> Column:
        start, stop = bit(F.shiftright(c, 6).bitwiseAND(63).cast("int")), bit(c.bitwiseAND(63).cast("int"))
        ends = start.bitwiseOR(stop)
        return F.when(cuts.bitwiseAND(ends) == ends, cuts.bitwiseAND(F.bitwise_not(stop - start).bitwiseOR(start))).otherwise(cuts)

    cuts = F.aggregate(merges, F.lit(-1).cast("long"), merge)
    places = lambda cuts: F.filter(F.sequence(F.lit(0), n), lambda i: F.getbit(cuts, i) == 1)
    pieces = lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, k: _rank(ranks, word.substr(a + 1, F.get(at, k + 1) - a)))
    return F.when(n <= FOLDED, _let(cuts, lambda c: _let(places(c), pieces)))


class Fold:
    """The ranked merges of the words of a row, with the arrays of ``Automaton`` and ``kept_column``, which the caller binds once for all words.

    Words are given by position: ``pairs`` has an array for each place, with the byte there and the byte before it of every word that is so long, longer words first."""

    def __init__(self, moves: Column, after: Column, ends: Column, ids: Column, kept: Column, longest: int):
        self.moves, self.after, self.ends, self.ids, self.kept, self.longest = moves, after, ends, ids, kept, longest

    def states(self, pairs: Column) -> Column:
        """By position, the automaton's states behind that byte of each word."""

        def step(state: Column, pair: Column) -> Column:
            row = F.shiftright(state, 20)
            move = F.get(self.moves, (row + pair.bitwiseAND(255)).cast("int"))
            return F.when(F.shiftright(move, 41) == row, move.bitwiseAND((1 << 41) - 1)).otherwise(F.get(self.after, pair))

        one = lambda last, at: F.transform(at, lambda pair, w: step(F.get(last, w), pair))
        return F.aggregate(pairs, F.array(F.array().cast("array<long>")), lambda done, at: F.concat(done, F.array(_let(F.element_at(done, -1), lambda last: one(last, at)))))

    def ending(self, kind: Column, states: Column, stop: Column, w: Column) -> Column:
        """What ends or ids have of the tokens that end at a place of the word w."""
        return F.get(kind, F.get(F.get(states, stop), w).bitwiseAND((1 << 20) - 1).cast("int"))

    def merges(self, states: Column, w: Column, n: Column) -> Column:
        """The possible merges of the word w of n bytes, as ``possible_merges`` has them but in the order of their ends."""
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda j: F.transform(self.ending(self.ends, states, j, w), lambda e: e + j * 65)))

    def word(self, states: Column, w: Column, n: Column) -> Column:
        """The ids of the word w of 1 to 62 bytes: a fold over its possible merges by rank, in which the cuts between bytes are the bits of a long."""
        bit = lambda cuts, i: F.getbit(cuts, i.bitwiseAND(63).cast("int")) == 1
        merge = lambda cuts, c: F.when(bit(cuts, F.shiftright(c, 6)) & bit(cuts, c), cuts.bitwiseAND(F.get(self.kept, c.bitwiseAND(4095).cast("int")))).otherwise(cuts)
        cuts = F.aggregate(F.sort_array(self.merges(states, w, n)), F.lit(-1).cast("long"), merge)
        stops = _let(cuts, lambda c: F.filter(F.sequence(F.lit(1), n), lambda i: bit(c, i)))
        before = lambda at, k: F.when(k == 0, 0).otherwise(F.get(at, k - 1))
        return _let(stops, lambda at: F.transform(at, lambda stop, k: F.get(self.ending(self.ids, states, stop, w), stop - before(at, k) - 1)))

    def windows(self, word: Column, keys: Column, start, size) -> Column:
        """Stretches of a word (array of bytes) as words by position: start(key) and size(key), which must not rise along the keys."""
        byte = lambda i: F.get(word, i)
        pair = lambda s, j: F.when(j == 0, byte(s) + 65536).otherwise(byte(s + j - 1) * 256 + byte(s + j))
        return F.transform(F.sequence(F.lit(0), F.lit(FOLDED - 1)), lambda j: F.transform(F.filter(keys, lambda x: size(x) > j), lambda x: pair(start(x), j)))

    def long_word(self, word: Column) -> Column:
        """The ids of a word (array of bytes) of more than 62 bytes: the same fold, in which the cuts are an array of booleans and all merges of a rank take effect at once, the leftmost first where they overlap.

        Possible merges are found in windows of 62 bytes, which overlap so that each has all that start in its first bytes.  Work grows with the length times the ranks that take effect."""
        n, stride = F.size(word), FOLDED - self.longest + 1
        start = lambda c: F.shiftright(c, 6).bitwiseAND((1 << 34) - 1).cast("int")
        stop = lambda c: start(c) + c.bitwiseAND(63).cast("int")
        size = lambda s: F.least(n - s, F.lit(FOLDED))
        same = lambda s: s

        def found(states: Column, starts: Column) -> Column:  # rank, start and length
            own = lambda s, w: F.filter(self.merges(states, w, size(s)), lambda c: F.shiftright(c, 6).bitwiseAND(63) < stride)
            wide = lambda s, c: F.shiftleft(F.shiftright(c, 12), 40).bitwiseOR(F.shiftleft(F.shiftright(c, 6).bitwiseAND(63) + s, 6)).bitwiseOR(c.bitwiseAND(63) - F.shiftright(c, 6).bitwiseAND(63))
            return F.sort_array(F.flatten(F.transform(starts, lambda s, w: F.transform(own(s, w), lambda c: wide(s, c)))))

        def by_rank(merges: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(merges) - 1), lambda i: (i == 0) | (F.shiftright(F.get(merges, i), 40) != F.shiftright(F.get(merges, i - 1), 40)))
            return F.when(F.size(merges) > 0, _let(firsts, lambda f: F.transform(f, lambda a, k: F.slice(merges, a + 1, F.coalesce(F.get(f, k + 1), F.size(merges)) - a)))).otherwise(F.array().cast("array<array<long>>"))

        def taken(open_: Column) -> Column:  # a list of 256 at a time begins with the last merge before it
            more = lambda done, c: F.when(start(c) >= stop(F.element_at(done, -1)), F.concat(done, F.array(c))).otherwise(done)
            part = lambda done, a: F.aggregate(F.slice(open_, a + 1, 256), F.array(F.element_at(F.element_at(done, -1), -1)), more)
            parts = F.aggregate(F.sequence(F.lit(0), F.size(open_) - 1, F.lit(256)), F.array(F.array(F.lit(0).cast("long"))), lambda done, a: F.concat(done, F.array(part(done, a))))
            return F.flatten(F.transform(parts, lambda x: F.slice(x, F.lit(2), F.size(x) - 1)))

        def cleared(cuts: Column, merges: Column) -> Column:
            before = lambda k: F.when(k == 0, 0).otherwise(stop(F.get(merges, k - 1)))
            inside = lambda c: F.array_repeat(F.lit(False), stop(c) - start(c) - 1)
            rest = stop(F.element_at(merges, -1))
            return F.concat(F.flatten(F.transform(merges, lambda c, k: F.concat(F.slice(cuts, before(k) + 1, start(c) - before(k) + 1), inside(c)))), F.slice(cuts, rest + 1, n + 1 - rest))

        def merge(cuts: Column, merges: Column) -> Column:
            open_ = F.filter(merges, lambda c: F.get(cuts, start(c)) & F.get(cuts, stop(c)))
            return _let(open_, lambda o: F.when(F.size(o) == 0, cuts).otherwise(_let(taken(o), lambda t: cleared(cuts, t))))

        def pieces(at: Column) -> Column:
            begin = lambda x: x.bitwiseAND((1 << 40) - 1).cast("int")
            length = lambda x: (FOLDED - F.shiftright(x, 40)).cast("int")
            keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.shiftleft((FOLDED - F.get(at, k + 1) + F.get(at, k)).cast("long"), 40) + F.get(at, k)))

            def ids(keys: Column, states: Column) -> Column:
                found = F.transform(keys, lambda x, w: F.shiftleft(begin(x).cast("long"), 20) + F.get(self.ending(self.ids, states, length(x), w), length(x) - 1))
                return F.transform(F.sort_array(found), lambda x: x.bitwiseAND((1 << 20) - 1).cast("int"))

            return _let(keys, lambda x: _let(self.states(self.windows(word, x, begin, length)), lambda s: ids(x, s)))

        merges = _let(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda starts: _let(self.states(self.windows(word, starts, same, size)), lambda s: found(s, starts)))
        cuts = F.aggregate(_let(merges, by_rank), F.array_repeat(F.lit(True), n + 1), merge)
        return _let(_let(cuts, lambda c: F.filter(F.sequence(F.lit(0), n), lambda i: F.get(c, i))), pieces)


def encode_pairwise(word: Column, ranks: Column) -> Column:
    """The ids of a word (binary) for any file of ranks, whose bound ``Ranks.map_column`` ranks is: the word's own id, or a fold that merges the lowest pair, of equal ones the leftmost, as often as the word has bytes."""
    piece = lambda at, k, m: _rank(ranks, word.substr(F.get(at, k) + 1, F.get(at, k + m) - F.get(at, k)))
    low = lambda at: F.when(F.size(at) > 2, F.transform(F.sequence(F.lit(0), F.size(at) - 3), lambda k: piece(at, k, 2)))

    def merge(at: Column, _: Column) -> Column:
        drop = lambda r: F.array_position(r, F.array_min(r)).cast("int")
        return _let(low(at), lambda r: F.when(F.array_min(r).isNull(), at).otherwise(F.concat(F.slice(at, F.lit(1), drop(r)), F.slice(at, drop(r) + 2, F.size(at)))))

    at = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.sequence(F.lit(0), F.octet_length(word)), merge)
    ids = _let(at, lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: piece(at, k, 1)))
    return _let(_rank(ranks, word), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(ids))


class Stretches:
    """The possible merges of many words by numpy; no query uses it, the tests compare ``possible_merges`` with it.  Tokens of up to 8 bytes are numbers in sorted arrays, longer ones are tried where their first 8 bytes fit."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {t: r for t, r in ranks.items() if len(t) > 8}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(t) for t in ranks if 2 <= len(t) <= FOLDED}):
            heads: dict[int, int] = {}
            for token, rank in ranks.items():
                if len(token) == size:
                    heads[int.from_bytes(token[:8], "big")] = rank
            keys = np.array(sorted(heads), np.uint64)
            self.by_length[size] = keys, np.array([heads[k] for k in keys.tolist()], np.int64)

    def of(self, words: list[bytes]) -> pa.Array:
        """The possible merges of each word, as ``possible_merges`` gives them; none for words of more than 62 bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        start = np.arange(len(data)) - begin[word]
        left = np.where(size[word] <= FOLDED, size[word] - start, 0)
        at, key = np.flatnonzero(left >= 2), np.zeros(0, np.uint64)
        key = data[at].astype(np.uint64)
        found = []
        for length in range(2, max(self.by_length, default=1) + 1):
            stay = left[at] >= length
            at, key = at[stay], key[stay]
            if not len(at):
                break
            if length <= 8:
                key = key << np.uint64(8) | data[at + length - 1]
            if length in self.by_length:
                keys, ranks = self.by_length[length]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[place] == key
                rank, own = ranks[place[hit]], at[hit]
                if length > 8:
                    rank = np.array([self.ranks.get(data[i : i + length].tobytes(), -1) for i in own.tolist()], np.int64)
                    rank, own = rank[rank >= 0], own[rank >= 0]
                found.append(word[own] << 40 | rank << 12 | start[own] << 6 | start[own] + length)
        merges = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        offsets = np.searchsorted(merges, np.arange(len(words) + 1) << 40)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(merges & ((1 << 40) - 1)))


def kept_column() -> Column:
    """By 64 times its start plus its stop, the cuts that a merge leaves, as a literal."""
    inside = [((1 << c % 64) - (2 << c // 64)) if c % 64 > c // 64 + 1 else 0 for c in range(4096)]
    return F.from_json(F.lit(json.dumps([-1 - i if i < 1 << 63 else (1 << 64) - 1 - i for i in inside])), "array<long>")


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of ids, piece after piece; pieces is ``Ranks.pieces_column``."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


class Splitter:
    """Cuts texts into the pattern's words; ``plain`` says that a run of Python's letters is one word of the pattern, which most pieces are.

    Classes of characters are those of the tiktoken library: where this process's ``regex`` module knows another Unicode
    version, pieces with a character they class differently are cut by the library's classes, spelled out."""

    def __init__(self, pattern: str):
        self.pattern, self.differ, self.spelled, self.plain = pattern, frozenset(), pattern, False
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
        one = {bytes([i]): i for i in range(256)}
        for name, opposite in ((r"\p{L}", r"\P{L}"), (r"\p{N}", r"\P{N}"), (r"\s", r"\S")):
            library = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks=one, special_tokens={})
            theirs = set(library.decode_bytes(library.encode_ordinary(every)).decode())
            if name == r"\p{L}":
                self.plain = pattern == public_tokenizers.PATTERN and theirs.issuperset(c for c in every if c.isalpha())
            self.differ |= theirs ^ set(regex.findall(name, every))
            self.spelled = self.spelled.replace(name, f"[{_ranges(theirs)}]").replace(r"\S" if name == r"\s" else "\0", f"[^{_ranges(theirs)}]")
        self.spelled, self.pattern = regex.compile("(?V1)" + self.spelled), regex.compile(pattern)  # sets may stand within sets

    def words(self, piece: str) -> list[str]:
        word = piece[1:] if piece[:1] == " " else piece
        if self.plain and word.isalpha():
            return [piece]
        if self.plain and word[-1:] in (".", ",") and word[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        exact = self.differ and not piece.isascii() and not self.differ.isdisjoint(piece)
        return (self.spelled if exact else self.pattern).findall(piece)


@functools.cache
def _splitter_of(pattern: str) -> Splitter:
    return Splitter(pattern)


@functools.cache
def _automaton_of(path: str) -> Automaton:
    return Automaton(_ranks_of(path).ranks)


@functools.cache
def _ranks_of(path: str) -> Ranks:
    with open(path, "rb") as file:
        return Ranks(file.read())


def _ranges(characters: set[str]) -> str:
    """The characters as ranges of a set."""
    codes = np.array(sorted(map(ord, characters)))
    breaks = np.flatnonzero(np.diff(codes) > 1)
    pairs = zip(codes[np.append(0, breaks + 1)].tolist(), codes[np.append(breaks, len(codes) - 1)].tolist(), strict=True)
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in pairs)


class _Numbers(dict):
    """Numbers words as they first occur."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _runs(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after the other."""
    stop = np.cumsum(sizes)
    return np.repeat(start - stop + sizes, sizes) + np.arange(int(stop[-1]) if len(stop) else 0)


#: A slice of rows: their words by number, the words that the task meets for the first time, and whether numbers start anew.  Of words of up to 62 bytes
#: their places in ``pairs`` (by position, longer ones first) and lengths, of others (-1, -2, ...) their bytes in ``long``; or all as ``words``, to be merged pair by pair.
_CUT = "keys array<long>, sizes binary, numbers binary, words array<binary>, places array<int>, lengths array<int>, pairs array<array<int>>, long array<array<int>>, anew boolean"


def _by_position(words: list[bytes]) -> dict[str, pa.Array]:
    """The columns places, lengths, pairs and long of these words."""
    size = np.fromiter(map(len, words), np.int32, len(words))
    long = size > FOLDED
    order = np.argsort(np.where(long, 0, -size), kind="stable")[: len(words) - int(long.sum())]  # longer ones first, those of other words last
    places = np.empty(len(words), np.int32)
    places[order], places[long] = np.arange(len(order)), -1 - np.arange(int(long.sum()))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    pair = np.append(0, data[:-1]) * 256 + data
    begin = np.cumsum(size, dtype=np.int64) - size
    pair[begin] = 65536 + data[begin]
    by = [pair[begin[order[: int((size[order] > j).sum())]] + j] for j in range(int(size[order].max(initial=0)))]
    one = lambda lists, kind: pa.array([lists], pa.list_(kind))
    return {
        "places": one(places, pa.int32()), "lengths": one(size, pa.int32()), "pairs": one(by, pa.list_(pa.int32())),
        "long": one([data[begin[i] : begin[i] + size[i]] for i in np.flatnonzero(long).tolist()], pa.list_(pa.int32())),
    }


def _cut_task(batches: Iterable[pa.RecordBatch], splitter: Splitter, pairwise: bool, remembered: int) -> Iterator[pa.RecordBatch]:
    numbers = _Numbers()
    numbers.new = []
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        first = 0
        while first < len(texts):
            stop = max(first + 1, int(np.searchsorted(size, size[first] + SLICE, "right")) - 1)
            anew = len(numbers) > remembered
            if anew:
                numbers.clear()
            numbers.new = []
            names, at, counts = _pieces(texts.slice(first, stop - first))
            # Each distinct piece is cut once; most are words that the task knows.
            whole = np.fromiter((numbers.get(p, -1) for p in names), np.int64, len(names))
            other = np.flatnonzero(whole < 0)
            own = [[numbers[w] for w in splitter.words(names[i])] for i in other.tolist()]
            length = np.ones(len(names), np.int64)
            length[other] = list(map(len, own))
            flat, cut = np.empty(int(length.sum()), np.uint32), np.repeat(whole < 0, length)
            flat[~cut] = whole[whole >= 0]
            flat[cut] = [x for o in own for x in o]
            held = length[at]
            found = flat[_runs((np.cumsum(length) - length)[at], held)]
            ends = np.concatenate([[0], np.cumsum(held)])[np.cumsum(counts)]
            words = [w.encode() for w in numbers.new]
            columns = {
                "keys": pa.array([batch.column(0).slice(first, stop - first).to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([np.diff(ends, prepend=0).astype("<u4").tobytes()], pa.binary()),
                "numbers": pa.array([found.tobytes()], pa.binary()), "words": pa.array([words if pairwise else []], pa.list_(pa.binary())), **_by_position([] if pairwise else words), "anew": pa.array([anew]),
            }
            yield pa.RecordBatch.from_pydict(columns)
            first = stop
    give_back()


#: No piece, or one that begins with white space, as the library has it.
_LOOSE = "^(?:$|[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}])"


def _pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches of the texts from a space before a non-space to the next such space, the number of every one in order, and how many each
    text has.  No word of the pattern reaches over such a space, which begins the word behind it."""
    lists = pc.split_pattern(texts, " ")
    counts = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    after = np.ones(len(codes), np.int64)
    after[np.cumsum(counts) - counts] = 0
    loose = pc.match_substring_regex(coded.dictionary, _LOOSE).to_numpy(zero_copy_only=False)
    if (loose[codes] & (after > 0)).any():
        own = [regex.split(r" (?=\S)", t) for t in texts.to_pylist()]
        coded = pa.array([" " + p if i else p for o in own for i, p in enumerate(o)], pa.string()).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.array([len(o) for o in own])
    key = codes * 2 + after
    used = np.flatnonzero(np.bincount(key, minlength=2 * len(names)))
    place = np.zeros(2 * len(names), np.int64)
    place[used] = np.arange(len(used))
    return [" " + names[k >> 1] if k & 1 else names[k >> 1] for k in used.tolist()], place[key], counts


class _Flat:
    """Runs of numbers or bytes, appended and gathered by number."""

    def __init__(self, kind: type):
        self.data, self.used, self.sizes = np.zeros(1 << 16, kind), 0, np.zeros(0, np.int64)

    def clear(self) -> None:
        self.used, self.sizes = 0, np.zeros(0, np.int64)

    def append(self, data: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(data)] = data
        self.used += len(data)
        self.sizes = np.concatenate([self.sizes, sizes])

    def gather(self, numbers: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after the other, and the offsets of the owners' shares: owners has how many numbers each has."""
        sizes = self.sizes[numbers]
        data = self.data[_runs((np.cumsum(self.sizes) - self.sizes)[numbers], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(owners)]
        return data, np.concatenate([[0], ends])


def _join_task(batches: Iterable[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Puts the words' ids and bytes together by row; batches come in the order in which this task cut them.  lengths: the bytes of each id."""
    ids, text = _Flat(np.int32), _Flat(np.uint8)
    for batch in batches:
        for row in range(batch.num_rows):
            keys, sizes, numbers, found, decoded, anew = (batch.column(i).slice(row, 1) for i in range(6))
            if anew[0].as_py():
                ids.clear()
                text.clear()
            lists = found.flatten()
            own, held = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids.append(own, held)
            stops = np.append(0, np.cumsum(lengths[own]))[np.append(0, np.cumsum(held))]
            text.append(np.frombuffer(decoded[0].as_py(), np.uint8), np.diff(stops))
            number, owner = np.frombuffer(numbers[0].as_py(), np.uint32), np.frombuffer(sizes[0].as_py(), "<u4").astype(np.int64)
            names = keys.flatten()
            flat, cuts = ids.gather(number, owner)
            data, ends = text.gather(number, owner)
            step = max(1, len(names) * SLICE // max(len(data), 1))
            for k in range(0, len(names), step):  # a slice holds a few MB, but one row may be larger
                a, b = k, min(k + step, len(names))
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(a, b - a), pa.ListArray.from_arrays(pa.array((cuts[a : b + 1] - cuts[a]).astype(np.int32)), pa.array(flat[cuts[a] : cuts[b]])),
                        pa.array([data[ends[i] : ends[i + 1]].tobytes() for i in range(a, b)], pa.binary()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )
    give_back()


def fold_words(tables: Column, ranks: Ranks) -> Column:
    """The ids of each new word of a slice (``_CUT``), in their order."""

    def words(fold: Fold) -> Column:
        def each(states: Column) -> Column:
            return F.zip_with("places", "lengths", lambda p, n: F.when(p >= 0, fold.word(states, p, n)).otherwise(fold.long_word(F.get("long", -1 - p))))

        return _let(fold.states(F.col("pairs")), each)

    arrays = lambda t, kept: _let(t["moves"], lambda m: _let(t["after"], lambda a: _let(t["ends"], lambda e: _let(t["ids"], lambda i: words(Fold(m, a, e, i, kept, ranks.longest))))))
    return _let(tables, lambda t: _let(kept_column(), lambda kept: arrays(t, kept)))


def encode_documents(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of every row of docs (doc_id, text), without special tokens, as the tiktoken library encodes.

    A null text is empty and has no ids; its decoded bytes are empty.  Rows that repeat a doc_id or have none are encoded like any other and
    keep their doc_id.  Texts are encoded whole, of any length, special strings as ordinary text.  An empty table gives no rows; other columns are not
    read.  Nothing is shuffled: a task cuts its rows, folds each new word and puts its rows together again."""
    ranks, splitter = _ranks_of(path), _splitter_of(pattern)
    pairwise, lengths = ranks.pairwise, ranks.lengths()
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _cut_task(it, splitter, pairwise, remembered), _CUT)
    if pairwise:
        coded = cut.withColumn("found", _let(ranks.map_column(), lambda known: F.transform("words", lambda w: encode_pairwise(w, known))))
    else:
        tables = docs.sparkSession.createDataFrame(_automaton_of(path).table, Automaton.SCHEMA)
        cut = cut.withColumn("tables", tables.select(F.struct("moves", "after", "ends", "ids")).scalar())
        coded = cut.withColumn("found", fold_words(F.col("tables"), ranks))
    decoded = _let(ranks.pieces_column(), lambda pieces: decode_ids(F.flatten("found"), pieces))
    coded = coded.select("keys", "sizes", "numbers", "found", decoded.alias("decoded"), "anew")
    return coded.mapInArrow(lambda it: _join_task(it, lengths), "doc_id long, ids array<int>, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    # Written once, with small Arrow batches: two Python workers a task share the executor's memory.
    return materialize(found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "byte-bpe")


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
