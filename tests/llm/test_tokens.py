"""Token ids against the libraries, packing and token files against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from transectra.llm import packing, pieces, tokenfile
from transectra.llm.frames import scratch
from transectra.llm.tokens import ByteLevelEncoder, PieceEncoder, WordEncoder, encoder, pack, public_path

from .conftest import awkward_rows, plain, prose

KINDS = {"byte": (ByteLevelEncoder, "byte_bpe_50k.json"), "word": (WordEncoder, "word_bpe_49k.json"), "piece": (PieceEncoder, "piece_bpe_32k.model")}
TEXTS = st.text(st.sampled_from(list("aBcé ßñ'.,!?-_09\n\t\r ▁  \x1c\0漢🎉s tdm")), max_size=40)


def library(kind: str):
    path = public_path(KINDS[kind][1])
    if kind == "piece":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text)
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda text: model.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=KINDS)
def pair(request):
    cls, name = KINDS[request.param]
    return cls(public_path(name)), library(request.param)


def test_ids_are_the_librarys(pair, given):
    ours, theirs = pair
    texts = [r.text or "" for r in given("documents").select("text").collect()] + [r[1] or "" for r in awkward_rows()]
    texts += ["", " ", "a  b", "a \n b", "a\n\nb", "\na b", "a b\n", "It's they'll DON'T", "▁a ▁b", "<s> </s> <|endoftext|>x", "a\r\nb"]
    for text, ids in zip(texts, ours.encode_all(texts)):
        assert ids == pack(theirs(text)), text[:80]


@settings(max_examples=300, deadline=None)
@drawn(text=TEXTS)
@pytest.mark.parametrize("kind", KINDS)
def test_ids_of_odd_texts(kind, text):
    cls, name = KINDS[kind]
    assert encoder(cls, public_path(name)).encode(text) == pack(_libraries(kind)(text))


_known = {}


def _libraries(kind):
    return _known.setdefault(kind, library(kind))


def test_a_full_memory_starts_again():
    small = WordEncoder(public_path("word_bpe_49k.json"), most=50)
    theirs = library("word")
    for i in range(30):
        text = prose(i, 80)
        assert small.encode(text) == pack(theirs(text))
    assert len(small.known) <= 130


def test_new_plain_words_come_from_one_call(monkeypatch):
    """Words after a space are asked for together, not each by itself, and keep the library's ids."""
    ours, theirs, asked, real = ByteLevelEncoder(public_path("byte_bpe_50k.json")), library("byte"), [], ByteLevelEncoder.stem
    monkeypatch.setattr(ByteLevelEncoder, "stem", lambda self, word: asked.append(word) or real(self, word))
    texts = [f"{prose(i, 60)} a{i}b über{i} don't ... straße, word,next {'z' * 70} {'y' * 70}.\nÉté{i} 漢字 Ġx\n'quoted' <|endoftext|>" for i in range(30)]
    assert ours.encode_all(texts) == [pack(theirs(t)) for t in texts]
    assert not [w for w in asked if w.startswith("Ġ")]
    small = ByteLevelEncoder(public_path("byte_bpe_50k.json"), most=50)
    assert [small.encode(t) for t in texts] == ours.encode_all(texts)


# --- packing ------------------------------------------------------------------------

def best_cost(at, penalty, window):
    """Quadratic version of the programme."""
    cost = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        cost[j] = min(cost[i] + window - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= window) + penalty[j]
    return cost[-1]


def test_cuts_cost_the_least():
    rng = np.random.default_rng(5)
    for _ in range(60):
        window = int(rng.integers(5, 60))
        n = int(rng.integers(1, 300))
        ends = np.unique(np.append(rng.integers(1, n + 1, 5), n))
        sentence = np.zeros(10, bool)
        sentence[3] = True
        at, penalty = packing.candidates(rng.integers(0, 10, n), ends, sentence, window)
        assert at[0] == 0 and at[-1] == n and (np.diff(at) <= window).all()
        cuts = packing.choose_cuts(at, penalty, window)
        assert (np.diff(cuts) <= window).all()
        cost = sum(window - np.diff(cuts)) + sum(penalty[np.searchsorted(at, cuts[1:])])
        assert cost == best_cost(at.tolist(), penalty.tolist(), window)


def test_little_padding_without_sentence_ends(spark):
    rng = np.random.default_rng(1)
    letters = np.asarray(list("abcdefghij"))
    word = lambda: "".join(rng.choice(letters, 4))
    words = [word() for _ in range(3000)]
    rows = [(i, " ".join(words[k] for k in rng.integers(0, 3000, 6000))) for i in range(60)] + [(100 + i, words[i]) for i in range(20)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("sequence_id").agg({"length": "sum"}).collect()
    used = [r[1] for r in got]
    assert max(used) <= packing.WINDOW and sum(used) > 0.97 * packing.WINDOW * len(used)


@pytest.mark.parametrize("block", [packing.BLOCK, 3000])
def test_pieces_cover_every_document_once(spark, given, awkward, block):
    theirs = library("word")
    docs = given("documents").unionByName(awkward.filter("doc_id > 15").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    rows = sorted(tuple(r) for r in packing.pack_documents(docs, block=block).collect())
    want = {r.doc_id: theirs(r.text or "") + [2] for r in docs.collect()}
    have = {}
    for doc, start, length, crc, size, _, _ in rows:
        part = want[doc][start:start + length]
        assert length > 0 and len(part) == length and size == len(want[doc])
        assert crc == zlib.crc32(np.asarray(part, "<u4").tobytes())
        assert start == have.get(doc, 0)
        have[doc] = start + length
    assert have == {d: len(x) for d, x in want.items()}
    windows = {}
    for doc, start, length, _, _, sequence, offset in rows:
        windows.setdefault(sequence, []).append((offset, length, doc, start))
    for parts in windows.values():
        parts.sort()
        assert [o for o, *_ in parts] == np.cumsum([0] + [n for _, n, *_ in parts[:-1]]).tolist()
        assert sum(n for _, n, *_ in parts) <= packing.WINDOW
    in_order = [(d, s) for q in sorted(windows) for _, _, d, s in windows[q]]
    assert in_order == sorted(in_order)


# --- token files --------------------------------------------------------------------

def test_code_lengths_are_best_and_limited():
    rng = np.random.default_rng(1)
    for n, longest in ((1, 4), (2, 1), (5, 3), (200, 8), (3000, 12), (3000, 18)):
        counts = rng.zipf(1.3, n)
        lengths = tokenfile.code_lengths(counts, longest)
        assert lengths.max() <= longest and (2.0 ** -lengths).sum() <= 1
        if longest == 18:
            import heapq

            heap, cost = counts.tolist(), 0
            heapq.heapify(heap)
            while len(heap) > 1:
                pair = heapq.heappop(heap) + heapq.heappop(heap)
                cost += pair
                heapq.heappush(heap, pair)
            assert (lengths * counts).sum() >= cost  # no prefix code beats Huffman's
            if lengths.max() < 18:
                assert (lengths * counts).sum() == cost
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(9), 3)


def test_blocks_decode_from_any_checkpoint():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (1023, 5), (1024, 5), (1025, 40000), (70000, 40000)):
        ids = np.minimum(rng.zipf(1.2, n), top).astype(np.uint32)
        lengths = tokenfile.code_lengths(np.bincount(ids))
        codes = tokenfile.canonical(lengths)
        table = tokenfile.decoding_table(lengths, codes)
        stream, bits, marks = tokenfile.encode_block(ids, lengths, codes)
        assert bits == lengths[ids].sum() and len(stream) == -(-bits // 8)
        assert (tokenfile.decode_block(stream, marks, n, table) == ids).all()


@pytest.mark.parametrize("block", [tokenfile.BLOCK, 2000])
def test_files_read_back(spark, given, block):
    docs, theirs, path = given("documents"), library("byte"), scratch(spark)
    tokenfile.write_tokens(docs, path, block=block)
    want, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = theirs(r.text or "") + [0]
        want.append((r.doc_id, start, ids))
        start += len(ids)
    assert sorted((r.doc_id, r.start, list(r.ids)) for r in tokenfile.read_tokens(spark, path).collect()) == want
    digests = [(d, s, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for d, s, x in want]
    assert plain(tokenfile.read_digests(spark, path)) == sorted(digests, key=repr)


# --- pieces -------------------------------------------------------------------------

def test_spans_and_decoded_texts_are_the_librarys(given, awkward):
    path = public_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = given("documents").unionByName(awkward.filter("doc_id > 13"))
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    for r in pieces.encode_pieces(docs).collect():
        text = next(t for d, t in texts if d == r.doc_id and model.encode(t) + [2] == list(r.ids))
        ours = list(zip(r.begins, r.ends))
        # The library gives a character's bytes to the last of its byte pieces; here each has its own.
        for (a, b), p in zip(ours, model.encode(text, return_type="proto").pieces, strict=True):
            assert b == a + 1 if model.is_byte(p.id) else (a, b) == (p.begin, p.end)
        assert all(x[1] == y[0] for x, y in zip(ours, ours[1:]))
        assert r.decoded == model.decode(list(r.ids))


def test_aligned_bytes_are_the_librarys_pieces(given, awkward):
    path = public_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normaliser = pieces._normaliser(path)
    assert not normaliser.map.units  # as the README says
    for r in given("documents").unionByName(awkward).select("text").collect():
        found = model.encode(r.text or "", return_type="proto").pieces
        joined = b"".join(bytes([int(p.piece[3:5], 16)]) if model.is_byte(p.id) else p.piece.encode() for p in found)
        aligned, origin = normaliser.align(r.text or "")
        assert aligned == joined
        assert len(origin) == len(aligned) + 1


def compiled(pairs: dict[bytes, bytes]) -> bytes:
    """A character map for tests: a double array placed greedily."""
    import struct

    targets, place = b"", {}
    for source, target in pairs.items():
        place[source] = len(targets)
        targets += target + b"\0"
    units = {0: [0, 0, False]}  # node -> [offset, label, has leaf]
    taken, values = {0}, {}

    def put(node: int, prefix: bytes) -> None:
        labels = sorted({s[len(prefix)] for s in pairs if s.startswith(prefix) and len(s) > len(prefix)})
        leaf = prefix in pairs
        offset = 1
        while (node ^ offset) in taken and leaf or any((node ^ offset ^ x) in taken for x in labels):
            offset += 1
        units[node][0], units[node][2] = offset, leaf
        if leaf:
            taken.add(node ^ offset)
            values[node ^ offset] = place[prefix] | 1 << 31
        for x in labels:
            taken.add(node ^ offset ^ x)
            units[node ^ offset ^ x] = [0, x, False]
        for x in labels:
            put(node ^ offset ^ x, prefix + bytes([x]))

    put(0, b"")
    out = [0] * (max(taken) + 300)
    for node, (offset, label, leaf) in units.items():
        out[node] = offset << 10 | leaf << 8 | label
    for node, value in values.items():
        out[node] = value
    trie = struct.pack(f"<{len(out)}I", *out)
    return struct.pack("<I", len(trie)) + trie + targets


def test_longest_source_string_wins_and_origins_follow():
    settings_ = pieces.Normaliser(b"")
    settings_.map = pieces.CharacterMap(compiled({b"a": b"1", b"ab": b"22", b"abc": b"", "ﬁ".encode(): b"fi", b"\t": b" "}))
    settings_.trim, settings_.dummy_prefix = False, False
    out, origin = settings_.align("abxaﬁ\tabc!")
    assert out == "22x1fi▁!".encode()
    assert origin.tolist() == [0, 0, 2, 3, 4, 4, 7, 7, 7, 11, 12]
    settings_.trim, settings_.dummy_prefix = True, True
    out, origin = settings_.align("  x \t y ")
    assert out == "▁x▁y".encode()
    assert origin.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]
