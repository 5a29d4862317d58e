"""Single-process parts against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import bpe, htmltext, linededup, media, minhash, recompression, textblocks, tokencount, toxicity

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_match_a_regular_expression():
    r = random.Random(1)
    texts = ["", None, "a", " a\tb\n", "É日 x", "".join(r.choice("aB \n\té🙂") for _ in range(3000))] * 3
    seen = {}
    for limit in (10, 1 << 20):
        got = []
        for block in textblocks.blocks(pa.array(texts, pa.string()), limit):
            w = textblocks.words(block, textblocks.NOT_SPACE, False)
            raw = block.data.tobytes()
            for k in range(block.hi - block.lo):
                part = slice(w.first[k], w.first[k + 1])
                found = [raw[a:b] for a, b in zip(w.start[part], w.end[part], strict=True)]
                got.append(found)
                for x, h in zip(found, w.hash[part].tolist(), strict=True):
                    assert seen.setdefault(x, h) == h
        assert got == [WORDS.findall((t or "").encode()) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_signature_keys_of_equal_and_tiny_sets():
    signer = minhash.Signer()
    one = np.array([5], np.uint64)
    assert len(set(signer.signature(one).tolist())) == 1 and (signer.keys(one) == signer.keys(one.copy())).all()


def test_banding_finds_pairs_at_the_threshold():
    r, signer, found = np.random.default_rng(1), minhash.Signer(), 0
    for n in (10, 40, 400):
        for _ in range(100):
            both = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            cut = n // 10
            a, b = np.sort(both[cut:]), np.sort(both[: n - cut])
            found += bool((signer.keys(a) == signer.keys(b)).any())
    assert found >= 298


def test_anchors_depend_on_the_window_alone():
    r = random.Random(2)
    for _ in range(60):
        alphabet = [r.randrange(1, 2**63) for _ in range(r.choice((1, 2, 5, 50)))]
        inner = [r.choice(alphabet) for _ in range(30)]
        names = []
        for _ in range(2):
            left, right = ([r.choice(alphabet) for _ in range(r.randrange(0, 9))] for _ in range(2))
            h = np.array(left + inner + right, np.uint64)
            start, name, _ = recompression.anchors(h, np.array([0, len(h)]))
            at = {s: n for s, n in zip(start.tolist(), name.tolist(), strict=True)}
            names.append([at[len(left) + k] for k in range(30 - recompression.WINDOW + 1)])
        assert names[0] == names[1]


def test_lines_and_sets():
    text = "ab\n\n  Xyz 12345678 \r\nshort"
    block = next(textblocks.blocks(pa.array([text, "", "last\n"])))
    lines = linededup.Lines(block)
    assert list(zip(lines.doc.tolist(), lines.number.tolist(), strict=True)) == [(0, 0), (0, 2), (0, 3), (2, 0)]
    g, at = lines.shingles()
    assert [len(set(g[a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)] == [len(linededup.brute_force_sets(x)) for x in ("ab", "  Xyz 12345678 ", "short", "last")]


def test_piece_counts_match_greedy_matching():
    r = random.Random(3)
    pieces = {b"a", b"b", b"c", b"abc", b"abcd", b"bcd", b"cde", b"dd", b"d", b"e"}
    counter = tokencount.PieceCounter(pieces)

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), None)
            if j is None:
                return 1
            n, i = n + 1, j
        return n

    for _ in range(5000):
        w = bytes(r.choice(b"abcdef") for _ in range(r.randrange(0, 12)))
        assert counter.count(w) == greedy(w)


def test_bpe_equals_the_library():
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(ranks, tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["", " \n\n ", "日本語🙂é", "x" * 3000, "c" * 3001, "ca" * 900, "<|endoftext|>", "".join(r.choice("thexiac é,.\n") for _ in range(3000)), "".join(r.choice("thexi") for _ in range(600))]
    ids = codec.encode(texts)
    assert ids == [",".join(map(str, enc.encode_ordinary(t))) for t in texts]
    assert codec.decode([bpe._parse(i) for i in ids]) == [t.encode() for t in texts]


def test_media_round_trip_and_damage():
    r = random.Random(5)
    for n in (0, 1, 191, 192, 193, 768, 769, 5000):
        payload = media.pad(bytes(r.randrange(32, 240) for _ in range(n)))
        stream = media.write_stream(payload)
        s = media.read_stream(stream)
        assert media.read_payload(stream, s) == payload and s.crc_bad == s.skipped == 0
        assert s.vbr["frames"] == s.frames == len(s.offsets) and s.samples == 1152 * s.frames and s.tags["TXXX"] == f"payload={len(payload)}"
    cut = media.read_stream(b"noise" + stream[:-10])
    assert cut.frames >= s.frames - 2 and cut.skipped > 0
    lost = bytearray(stream)
    lost[s.offsets[2]] = 0
    assert media.read_stream(bytes(lost)).frames >= s.frames - 2
    flip = bytearray(stream)
    flip[s.offsets[1] + 8] ^= 1
    assert media.read_stream(bytes(flip)).crc_bad == 1
    assert media.read_stream(b"").frames == 0 and media.read_stream(b"\xff" * 999).frames == 0
    assert media.crc16(b"123456789") == 0xAEE7


def test_fold_and_lexicon():
    assert toxicity.fold("An ÍDIÓT!") == " an idiot " and toxicity.fold("іdi0t") == " idiot " and toxicity.fold("") == " "
    m = toxicity.Matcher(toxicity.Lexicon({" idiot ": 5.0, " trash ": 4.0, " low": 2.0}, ["trash can"]))
    assert m.weigh(toxicity.fold("1D10T lowest trash can"))[1:] == (2, 1)
    assert m.weigh(toxicity.fold("midiot trash"))[1:] == (1, 0)


def test_html():
    page = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>h</header><div class="cookie-notice">c</div>'
        "<article><h1>A &amp;amp; B</h1><p><b>x</b>y<br>z<script>var a='</p>';</script><p>q</p><form>f</form></article>"
        '<section id="comments"><article>reader</article></section><aside>s</aside><footer>f'
    )
    assert htmltext.main_text(page, {}) == "A &amp; B xy z q"
    assert htmltext.main_text("", {}) == "" and htmltext.main_text("plain &lt;b&gt;", {}) == "plain <b>"


def test_digest_helpers():
    assert linededup.digest(None) == hashlib.sha256(b"").hexdigest()
