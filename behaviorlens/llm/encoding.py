"""Encoding of many texts with a tokenizers file, each distinct piece once.

The library's own encoder spends most of its time on normalising, splitting and on words it
has just seen.  Texts here are cut at single spaces and line ends, which no token of the two
supported kinds can cross; Arrow numbers the distinct pieces of a slice of texts, and only
pieces that are new go to the library.  A text with runs of white space where they matter, and any file of
another kind, is encoded whole by the library, so that ids are always those of the library.

Special strings in a text are ordinary text (``encode_special_tokens``): a document cannot
forge the end of a document.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Bytes of text encoded in one go, and pieces remembered before the memory starts anew.
SLICE, REMEMBERED = 2 << 20, 200_000
#: Words that the library's model is given in one call.
WORDS = 400
#: What stands for a mark that ends a word and is a token of its own while texts are cut.
MARKS = {".": "\x01", ",": "\x02"}

_WORD = re.compile(r" ?[^\W\d_]*")
_RUN, _SIGN = re.compile(r"\s\s"), re.compile("[\x01\x02]")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = _BYTES[32]


class _Index(dict):
    """Numbers pieces as they first occur."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def slices(texts: pa.Array, most: int = SLICE):
    """(first, stop) of runs of rows that hold about ``most`` bytes; a larger text has a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


class Encoder:
    """Encodes Arrow arrays of texts; at most ``remembered`` pieces are kept from one slice to the next."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads keep memory each
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pre, norm = (json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer))
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and not norm and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "spaced"
        elif parts == ["Split", "ByteLevel"] and [p.get("type") for p in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "words"
        self.remembered = remembered
        if self.kind != "whole":
            # The model alone, for words that are one token of the splitter each: a vocabulary entry tells whether it begins or ends a word.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.edge = np.zeros(max(vocab.values()) + 1, bool)
            suffix = self.tokenizer.model.end_of_word_suffix
            self.edge[[i for t, i in vocab.items() if (t.endswith(suffix) if self.kind == "words" else t.startswith(_SPACE))]] = True
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the texts, one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum())), sizes

    def _word(self, piece: str) -> str | None:
        """What the model is given for a piece that is one word of letters; None for any other piece."""
        word = piece[1:] if self.kind == "spaced" and piece[:1] == " " else piece
        if not word.isalpha():
            return None
        if self.kind == "words":
            if word.isascii():
                return word.lower()
            if not unicodedata.is_normalized("NFC", word) or "\u03a3" in word:  # lower case depends on more than the character
                return None
            piece = word.lower()
            if not piece.isalpha():
                return None
        elif word.isascii():
            return _SPACE + word if word is not piece else None
        elif word is piece:
            return None
        return "".join(map(_BYTES.__getitem__, piece.encode()))

    def _model_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the model's alphabet, many in one call, cut apart at the tokens that begin or end a word."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        parts = [words[k : k + WORDS] for k in range(0, len(words), WORDS)]
        for part, found in zip(parts, self.model.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False), strict=True):
            own = np.array(found.ids, np.uint32)
            at = np.flatnonzero(self.edge[own])
            size = np.diff(at, prepend=-1) if self.kind == "words" else np.diff(at, append=len(own))
            if len(at) != len(part) or size.sum() != len(own):  # a vocabulary that marks words in another way
                each = [self.model.encode(w, add_special_tokens=False).ids for w in part]
                own, size = np.concatenate([np.array(e, np.uint32) for e in each]), np.array([len(e) for e in each])
            ids.append(own)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self) -> None:
        """Encode the pieces that were new."""
        pieces = self.index.new
        marks = {sign: mark for mark, sign in MARKS.items()}
        words, own, hard, parted = [], [], [], []
        for i, piece in enumerate(pieces):  # grows by the parts of pieces
            word = self._word(piece)
            if word is not None:
                own.append(i)
                words.append(word)
                continue
            # No token reaches from a word into the marks behind it; only what is not ASCII may compose with it.
            cut = _WORD.match(piece).end()
            if 0 < cut < len(piece) and piece[cut].isascii() and self._word(piece[:cut]) is not None:
                parted.append((i, self.index[piece[:cut]], self.index[piece[cut:]]))
            else:
                hard.append(i)
        self.index.new = []
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        rest = [marks.get(pieces[i], pieces[i]) for i in hard]
        for places, (ids, sizes) in ((own, self._model_ids(words)), (hard, self._whole(rest))):
            start[places], length[places] = self._append(ids, sizes), sizes
        first = len(self.start)
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        if parted:
            parts = np.array(parted)
            both = parts[:, 1:].ravel()
            whole = self.length[both].reshape(-1, 2).sum(1)
            place = first + parts[:, 0]
            self.start[place], self.length[place] = self._append(self._gather(self.start[both], self.length[both]), whole), whole

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds ids to the flat array; gives where each run of these sizes starts there."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        return begin

    def _gather(self, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The runs of the flat array one after the other."""
        stop = np.cumsum(sizes)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(start - stop + sizes, sizes) + np.arange(total)]

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each piece of the texts, how many pieces each text has, and the texts that cannot be cut so."""
        spaced = self.kind == "spaced"
        texts = pc.replace_substring(texts, "\n", " \n " if spaced else " ")
        for mark, sign in MARKS.items():
            texts = pc.replace_substring(texts, f"{mark} ", f" {sign} ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = lists.offsets.to_numpy()
        known = {name: names.index(name) for name in ("\n", *MARKS.values()) if name in names}
        signs = [known[s] for s in MARKS.values() if s in known]
        ends = np.flatnonzero(codes == known["\n"]) if spaced and "\n" in known else np.zeros(0, np.int64)
        marked = np.flatnonzero(np.isin(codes, signs)) if signs else np.zeros(0, np.int64)
        # A mark is a token of its own only behind a word.
        before = codes[marked - 1]
        word = np.zeros(len(names), bool)
        for k in np.unique(before).tolist():
            word[k] = names[k].isalpha() and (spaced or self._word(names[k]) is not None)
        odd = np.zeros(len(first) - 1, bool)
        wrong = marked[~word[before] | np.isin(marked, first)]
        odd[np.searchsorted(first, wrong, "right") - 1] = True
        key = codes.astype(np.int64)
        if spaced:  # all but a text's first piece, line ends and what follows them have a space before
            after = np.ones(len(codes), bool)
            after[first[:-1]] = False
            after[ends] = False
            after[ends + 1] = False  # a line end is never a text's last piece
            after[marked] = False
            key = key * 2 + after
        used = np.zeros(len(names) * (1 + spaced), bool)
        used[key] = True
        kinds = np.flatnonzero(used)
        own = [" " + names[k >> 1] if k & 1 else names[k >> 1] for k in kinds.tolist()] if spaced else names
        place = np.zeros(len(used), np.int64)
        place[kinds] = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
        return place[key], np.diff(first), odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (null counts as empty), and how many each text has."""
        texts = pc.fill_null(texts, "")
        if self.kind == "whole":
            return self._whole(texts.to_pylist())
        odd = np.array([bool(_SIGN.search(t) or self.kind == "spaced" and _RUN.search(t)) for t in texts.to_pylist()], bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if len(self.index) > self.remembered:
            self._clear()
        at, pieces, uncut = self._pieces(plain)
        odd |= uncut
        if self.index.new:
            self._learn()
        sizes = self.length[at]
        if odd.any():
            sizes[np.repeat(odd, pieces)] = 0
        ids = self._gather(self.start[at], sizes)
        sizes = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(pieces)], prepend=0)
        if odd.any():
            whole, sizes[odd] = self._whole(texts.filter(pa.array(odd)).to_pylist())
            out = np.zeros(int(sizes.sum()), np.uint32)
            owner = np.repeat(odd, sizes)
            out[owner], out[~owner] = whole, ids
            ids = out
        return ids, sizes
