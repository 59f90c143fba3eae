"""Token ids through caches: the ids of a whole text are the joined ids of its words.

Two layouts of ``tokenizers`` files are split into independent words: BPE with
word ends over lower-cased text, and byte-level BPE with a leading space. The
words' ids come from a cache in each Python worker, bounded in bytes, and misses from tiktoken's
merge loop over the same vocabulary (each token there has one merge rule, so
rank order decides both alike). A text with a special token's string, or with a
character outside a plain set, whose class or case libraries may see
differently, goes to the ``tokenizers`` library whole, as does every text for
any other layout. Nothing is truncated or padded.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

#: Bytes of words and ids that a worker's cache holds before it starts anew, bytes that Python needs for an entry besides, and characters from which a word is not kept.
CACHE_BYTES, ENTRY_BYTES, LONG_WORD = 48 << 20, 200, 64
#: Characters whose class, case and normal form are the same everywhere.
PLAIN = "\t\n\r" + "".join(map(chr, (*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x131, 0x149), *range(0x14A, 0x17F), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC)))
WORD_END = b"\xff"


def resolve(name: str) -> str:
    """A path as it is, else the file of the installed public vocabularies."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)


class _Cache(dict):
    """Word -> what ``make`` says of it, made on a miss; bounded in bytes.

    Two generations: when the young one is full it becomes the old one, from
    which words that occur again are taken back, so frequent words stay.
    """

    def __init__(self, make, most: int, size=len):
        super().__init__()
        self.make, self.most, self.size, self.held, self.old = make, most // 2, size, 0, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > LONG_WORD:
                return found
        if self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += ENTRY_BYTES + 2 * len(word) + self.size(found)
        self[word] = found
        return found


def _packed(ids: list[int], kind: str) -> bytes:
    """Ids as little-endian bytes."""
    out = array("I" if kind == "<u4" else "H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    def __init__(self, name: str, cache_bytes: int = CACHE_BYTES):
        path = resolve(name)
        self.library, self.words, self.lower, self.lengths = None, None, False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: model.encode(text, num_threads=1)
            return
        self.path, self.whole = path, self._by_library
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        special = [x["content"] for x in spec["added_tokens"]]
        letters, numbers = _class("L"), _class("N")
        if model["type"] != "BPE" or model.get("dropout") or len(model["merges"]) != len({"".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]}):
            return
        if model.get("end_of_word_suffix") == "</w>" and pre.get("type") == "Sequence":
            self.lower, inner, chunk = True, f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+", None
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]:
            inner = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\\s{letters}{numbers}]+|\\s+(?!\\S)|\\s+"
            chunk = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
        else:
            return
        import tiktoken

        of, end = _byte_of_letter(), WORD_END if self.lower else b""
        ranks = {}
        for token, i in model["vocab"].items():
            if token not in special:
                last = bool(end) and token.endswith("</w>")
                ranks[bytes(of[c] for c in (token[:-4] if last else token)) + end * last] = i
        piece = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        split = re.compile(inner).findall

        def encode(word: str) -> list[int]:
            return [i for part in split(word) for i in piece(part.encode() + end)]

        #: By width of an id; and the number of ids, for callers that only count.
        self.caches = {kind: _Cache(lambda word, kind=kind: _packed(encode(word), kind), cache_bytes) for kind in ("<u4", "<u2")}
        self.lengths = _Cache(lambda word: len(encode(word)), cache_bytes, lambda n: 0)
        self.words = str.split if chunk is None else chunk.findall
        self.odd = re.compile("[^" + re.escape(PLAIN) + "]" + "".join("|" + re.escape(x) for x in special)).search

    def _by_library(self, text: str) -> list[int]:
        """Ids as the library gives them; it is loaded when the first text needs it."""
        if self.library is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def split(self, text: str) -> list[str] | None:
        """The text's words, whose ids join to the text's; None where only the library may encode it."""
        if self.words is None or self.odd(text):
            return None
        return self.words(text.lower() if self.lower else text)

    def encode(self, text: str, kind: str = "<u4") -> bytes:
        """All ids of the text, little-endian: unsigned 32-bit, or 16-bit (``<u2``), which an id above refuses."""
        if (words := self.split(text)) is None:
            return _packed(self.whole(text), kind)
        return b"".join(map(self.caches[kind].__getitem__, words))

    def count(self, text: str) -> int:
        if (words := self.split(text)) is None:
            return len(self.whole(text))
        return sum(map(self.lengths.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
