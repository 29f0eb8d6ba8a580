"""Exact token ids of public tokenizers, with a memory of the chunks met before.

A tokenizer's result for a text is the concatenation of its results for chunks, if
the chunks are cut where neither its pre-tokenizer nor its merges can reach across.
Most chunks are words that come back all the time, so each worker keeps the ids of
those it has met (a bounded number) and asks the library for the others only. Texts
with unusual white space, where the cut could be unsafe, go to the library whole.

Ids are little-endian unsigned 32-bit integers packed in ``bytes``.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Worker processes are many already; the library's own threads would only compete.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks kept per worker process and tokenizer; about 200 bytes each.
REMEMBERED = 400_000
#: Longer chunks are not worth remembering.
LONGEST = 64
#: Texts whose unknown chunks are asked for together.
TOGETHER = 32
#: Characters of texts that are cut together by column functions.
CUT_TOGETHER = 4_000_000

_USUAL_SPACE = " \n\t\r"
_ODD_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in _USUAL_SPACE)
_ODD_ASCII_SPACE = tuple(c for c in _ODD_SPACE if c < "\x80")
_PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_STOPS = ".,!?;:"
_PLAIN_AND_STOPS = re.compile(f"({_PLAIN_WORD.pattern})([{_STOPS}]*)")
_RUNS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
# First characters of keys: what stands before the word. No mark means one space.
_BARE, _LINE = "\0", "\n"


def public_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids) -> bytes:
    return array("I", ids).tobytes()


def odd_space(text: str) -> bool:
    return any(c in text for c in (_ODD_ASCII_SPACE if text.isascii() else _ODD_SPACE))


def _visible_bytes() -> dict[int, str]:
    """Byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others as 256, 257, ..."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_VISIBLE = _visible_bytes()


def _byte_level(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)


class ChunkEncoder:
    """Remembers ids of chunks; a kind of tokenizer says how to cut and how to ask for new ones."""

    def __init__(self, most: int = REMEMBERED):
        self.known: dict[str, bytes] = {}
        self.most = most

    def chunks(self, text: str) -> list[str] | None:
        """Keys of a text, or None if it must go to the library whole."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def fetch(self, keys: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), TOGETHER):
            out += self._together(texts[i:i + TOGETHER])
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) if t else [] for t in texts]
        known = self.known
        new = [k for keys in cut if keys for k in keys if k not in known]
        if new:
            new = list(set(new))
            if len(known) + len(new) > self.most:
                # Start again; the common words are back within a few texts.
                known.clear()
                new = list({k for keys in cut if keys for k in keys})
            known.update(zip(new, self.fetch(new)))
        get = known.__getitem__
        out = [self.whole(t) if keys is None else b"".join(map(get, keys)) for t, keys in zip(texts, cut)]
        for k in new:
            if len(k) > LONGEST:
                del known[k]
        return out


class LibraryBpe(ChunkEncoder):
    """BPE of the ``tokenizers`` library over byte-level words."""

    space = ""

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.stems: dict[str, bytes] = {}

    def library_ids(self, texts: list[str]) -> list[bytes]:
        return [pack(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return self.library_ids([text])[0]

    def stem(self, word: str) -> bytes:
        """Ids of a plain word by the library's model: the pre-tokenizer would hand it over as it is."""
        out = self.stems.get(word)
        if out is None:
            out = pack([t.id for t in self.library.model.tokenize(word)])
            if len(self.stems) >= self.most // 2:
                self.stems.clear()
            if len(word) <= LONGEST:
                self.stems[word] = out
        return out


class ByteLevelEncoder(LibraryBpe):
    """Byte-level BPE whose pre-tokenizer attaches one space to the word after it."""

    # Plain words are remembered among the chunks, not apart in a memory of their own.
    def __init__(self, path: str, most: int = REMEMBERED * 2):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, most)
        self.line = self.library_ids(["\n"])[0]
        # The same model over words that are cut and written in visible bytes already.
        self.ready = Tokenizer(self.library.model)
        self.ready.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ids = self.library.get_vocab()
        self.opens = np.zeros(max(ids.values()) + 1, bool)
        self.opens[[i for token, i in ids.items() if token.startswith("Ġ")]] = True

    @staticmethod
    def usual(text: str) -> bool:
        """Single spaces and newlines stand between words, and only there."""
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text
                    or text[0] in " \n" or text[-1] in " \n" or "\0" in text or odd_space(text))

    def chunks(self, text: str) -> list[str] | None:
        if odd_space(text):
            return None
        if not self.usual(text):
            # A run of white space and what follows it never share a match with what stands before.
            return [_BARE + x for x in _RUNS.findall(text)]
        return (_BARE + text.replace("\n", " \n")).split(" ")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        usual = [i for i, t in enumerate(texts) if t and self.usual(t)]
        others = sorted(set(range(len(texts))).difference(usual))
        for i, ids in zip(others, super().encode_all([texts[i] for i in others])):
            out[i] = ids
        at = 0
        while at < len(usual):
            some, size = [], 0
            while at < len(usual) and size < CUT_TOGETHER:
                some.append(usual[at])
                size += len(texts[usual[at]])
                at += 1
            for i, ids in zip(some, self._usual_together([texts[i] for i in some])):
                out[i] = ids
        return out

    def _usual_together(self, texts: list[str]) -> list[bytes]:
        """Texts are cut and their different chunks found by column functions; only these are looked up one by one."""
        cut = pc.split_pattern(pa.array([_BARE + t.replace("\n", " \n") for t in texts], pa.string()), " ")
        chunks = cut.flatten().dictionary_encode()
        keys, known = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        found = list(map(known.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if len(known) + len(new) > self.most:
            known.clear()
        for i, x in zip(new, self.fetch([keys[i] for i in new])):
            found[i] = x
            if len(keys[i]) <= LONGEST:
                known[keys[i]] = x
        ids, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, which = np.cumsum(size) - size, chunks.indices.to_numpy()
        n = size[which]
        ends = np.append(0, np.cumsum(n))
        packed = ids[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (ends[cut.offsets.to_numpy()] * 4).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def parts(self, library, text: str, words: list[str]) -> list[bytes]:
        """Ids of words that stand after one space each in ``text``, all from one call of the library."""
        ids = np.asarray(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        # Only the first id of a word begins with its space.
        cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4
        if len(cuts) != len(words) + 1:
            raise ValueError(f"{len(cuts) - 1} words came back of {len(words)}")
        packed, cuts = ids.tobytes(), cuts.tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def fetch(self, keys: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(keys)
        known, stem_of, full = self.known, self.stem, _PLAIN_AND_STOPS.fullmatch
        bare, stopped, odd, at, asked, marked = [], [], [], [], [], []
        for i, k in enumerate(keys):
            if len(k) > LONGEST:
                odd.append(i)
            elif k.isascii() and k.isalpha():
                bare.append(i)
            elif m := full(k):
                stopped.append((i, *m.groups()))
            else:
                odd.append(i)
        words = [keys[i] for i in bare]
        words += {word for _, word, _ in stopped}.difference(known, words)
        # Words in visible bytes already.
        ids = self.parts(self.ready, "Ġ" + " Ġ".join([w if w.isascii() else _byte_level(w) for w in words]) if words else "", words)
        known.update(zip(words, ids))
        for i, x in zip(bare, ids):
            out[i] = x
        for i, word, stops in stopped:
            out[i] = known[word] + stem_of(stops) if stops else known[word]
        for i in odd:
            k = keys[i]
            if k[0] not in "\0\n":
                at.append(i)
                asked.append(k)
                continue
            # After a newline that follows a word, a word is matched as at the start of a text.
            word = k[1:]
            stem = word.rstrip(_STOPS)
            if _PLAIN_WORD.fullmatch(stem):
                out[i] = stem_of(_byte_level(stem)) + (stem_of(word[len(stem):]) if len(stem) < len(word) else b"")
            else:
                marked.append(i)
        for i, x in zip(at, self.parts(self.library, " " + " ".join(asked) if asked else "", asked)):
            out[i] = x
        for i, x in zip(marked, self.library_ids([keys[i][1:] for i in marked])):
            out[i] = x
        for i in odd:
            if keys[i][0] == "\n":
                out[i] = self.line + out[i]
        return out


class WordEncoder(LibraryBpe):
    """BPE with word ends that drops white space and lower-cases."""

    def chunks(self, text: str) -> list[str] | None:
        return None if odd_space(text) else text.split()

    def fetch(self, keys: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(keys)
        asked, at = [], []
        for i, word in enumerate(keys):
            stem = word.rstrip(_STOPS)
            if _PLAIN_WORD.fullmatch(stem):
                out[i] = self.stem(_byte_level(stem.lower()))
                if len(stem) < len(word):
                    out[i] += self.stem(word[len(stem):])
            else:
                at.append(i)
                asked.append(word)
        for i, ids in zip(at, self.library_ids(asked)):
            out[i] = ids
        return out


class PieceEncoder(ChunkEncoder):
    """SentencePiece BPE without normalisation of its own (``identity``) and with a dummy prefix.

    Merges cannot cross from a character to a following space mark, nor touch a
    newline, if no piece of the vocabulary does; that is looked up in the model.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        import sentencepiece

        super().__init__(most)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        plain = self.library.encode("a  b\nc", out_type=str)
        self.cuttable = not any(re.search("[^▁]▁|\n", p) for p in pieces) and "".join(plain).startswith("▁a▁▁b")

    def whole(self, text: str) -> bytes:
        return pack(self.library.encode(text))

    def chunks(self, text: str) -> list[str] | None:
        if (not self.cuttable or "▁" in text or "\0" in text or "  " in text or " \n" in text or "\n " in text
                or text[0] in " \n" or text[-1] == " "):
            return None
        return text.replace("\n", " \n").split(" ")

    def fetch(self, keys: list[str]) -> list[bytes]:
        # Before a newline the dummy prefix stays a piece of its own; inside a text it is not there.
        return [pack(ids[1:] if k[0] == "\n" else ids) for k, ids in zip(keys, self.library.encode(keys, num_threads=1))]


@lru_cache(maxsize=4)
def encoder(kind: type, path: str):
    """The encoder of this worker process, made once."""
    return kind(path)
