"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

A tokenizer that drops white space and never joins letters with other signs gives a text the ids of its words one after the
other. So a process encodes each different word once and puts texts together from the words' ids. A word here is a run
without ASCII white space, cut between ASCII letters and ASCII digits or signs other than ``'`` (whose endings ``'s``,
``'t`` ... are units of the pattern). Texts that hold an added token, and all texts under other tokenizers, are encoded whole.

Words are told apart by 64-bit hashes; the chance that one of w different words meets another one's hash in a process that remembers k of
them is w * k / 2**64. Null texts are empty.
"""

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textkin.llm.words import U64, Words

#: Most words that a process remembers; beyond it starts anew.
KNOWN_WORDS = 1 << 21
#: New words that are encoded in one call.
ENCODED_AT_ONCE = 10_000

# Fixed value: the pattern of units of a tokenizer that works word by word.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _SIGN, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.int8)
_CLASS[33:127] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[ord("'")] = _OTHER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: Whether a word ends between two bytes of these classes.
_EDGE = np.zeros((4, 4), bool)
_EDGE[_SPACE] = _EDGE[:, _SPACE] = True
_EDGE[_SPACE, _SPACE] = False
_EDGE[_LETTER, _SIGN] = _EDGE[_SIGN, _LETTER] = True

_encoders = {}


def units(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of the texts, and whether each consists of ASCII letters alone."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = _EDGE[kind[:-1], kind[1:]]
    edge[offsets] = True  # a text ends its last word
    at = np.flatnonzero(edge)
    solid = kind[at[:-1]] != _SPACE if len(data) else np.empty(0, bool)
    starts, ends = at[:-1][solid], at[1:][solid]
    # A word of other bytes may hold letters behind them; only words all of letters are plain.
    odd = np.concatenate([[0], np.cumsum(kind != _LETTER)])
    return Words(data, starts, ends, np.searchsorted(starts, offsets)), odd[starts] == odd[ends]


class Encoder:
    """A tokenizer with the words that this process has met."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        model = spec["model"]
        self.by_words = (split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed" and bool(self.added)
                         and not spec.get("post_processor") and model.get("end_of_word_suffix") == "</w>")
        vocab = self.tokenizer.get_vocab(True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        if self.by_words:
            self.border = vocab[self.added[0]]
            self.last = np.zeros(self.size, bool)
            self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self):
        self.known, self.at, self.count, self.flat = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _encode_words(self, words: list[str], plain: np.ndarray):
        """Ids of new words and how many each has."""
        ids, counts = [], np.zeros(len(words), np.int64)
        for kind, glue in ((True, " "), (False, self.added[0])):
            which = np.flatnonzero(plain == kind)
            for k in range(0, len(which), ENCODED_AT_ONCE):
                some = which[k:k + ENCODED_AT_ONCE]
                out = self.whole(glue.join(words[i] for i in some))
                if kind:  # a word of letters is one unit and ends at its only end-of-word id
                    ends = np.flatnonzero(self.last[out]) + 1
                    counts[some] = np.diff(ends, prepend=0)
                else:
                    cuts = np.flatnonzero(out == self.border)
                    counts[some] = np.diff(np.concatenate([[-1], cuts, [len(out)]])) - 1
                    out = out[out != self.border]
                ids.append((some, out))
        starts = np.zeros(len(words), np.int64)
        at = 0
        for some, out in ids:
            starts[some] = at + np.cumsum(counts[some]) - counts[some]
            at += len(out)
        return np.concatenate([out for _, out in ids]) if ids else np.empty(0, self.dtype), starts, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one entry more than texts)."""
        apart = np.zeros(len(texts), bool)
        if self.by_words:
            for token in self.added:
                apart |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        else:
            apart[:] = True
        if apart.any():
            parts = [None] * len(texts)
            easy = np.flatnonzero(~apart)
            if len(easy):
                ids, ends = self.encode(texts.take(pa.array(easy)))
                for i, a, b in zip(easy, ends[:-1], ends[1:]):
                    parts[i] = ids[a:b]
            for i in np.flatnonzero(apart):
                parts[i] = self.whole(texts[int(i)].as_py() or "")
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        words, plain = units(texts)
        if not len(words):
            return np.empty(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        own, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, own)
        seen = np.zeros(len(own), bool)
        inside = place < len(self.known)
        seen[inside] = self.known[place[inside]] == own[inside]
        if not seen.all():
            if len(self.known) + (~seen).sum() > KNOWN_WORDS:
                self.forget()
                place, seen = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
            new = np.flatnonzero(~seen)
            data = words.data.tobytes()
            text = [data[a:b].decode() for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())]
            ids, starts, counts = self._encode_words(text, plain[first[new]])
            self.known = np.insert(self.known, place[new], own[new])
            self.at = np.insert(self.at, place[new], starts + len(self.flat))
            self.count = np.insert(self.count, place[new], counts)
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.known, own)
        at, count = self.at[place][inverse], self.count[place][inverse]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = self.flat[np.repeat(at - ends[:-1], count) + np.arange(ends[-1])]
        return out, ends[words.first]


def encoder(path: str) -> Encoder:
    """The process's encoder of a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
