"""Packing and secret scan against brute force."""
import collections
import random
import zlib

import edge
import numpy as np
from keyspan.llm import packing, secrets

SF = "/root/testdata/sf0.01"


def whole_ids(text):
    from tokenizers import Tokenizer
    if not hasattr(whole_ids, "t"):
        whole_ids.t = Tokenizer.from_file(packing.default_vocabulary())
    return whole_ids.t.encode(text or "", add_special_tokens=False).ids + [2]


def check_pack(df, window=4096):
    rows = packing.pack(df, window=window).collect()
    want = collections.Counter((r.doc_id, tuple(whole_ids(r.text))) for r in df.collect())
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.token_ids, "<u4")
        assert len(ids) == r.length > 0
        by_doc[r.doc_id].append((r.start, tuple(ids.tolist()), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    # each document's ids, piece after piece, each in exactly one piece
    for doc_id, pieces in by_doc.items():
        need = collections.Counter()
        for (d, ids), n in want.items():
            if d == doc_id:
                for _ in range(n):
                    need.update(enumerate(ids))
        got = collections.Counter()
        for start, ids, _ in pieces:
            got.update(enumerate(ids, start))
        assert got == need
    assert set(by_doc) == {d for d, _ in want}
    padded = 0
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return rows, padded


def test_pack_edges(spark):
    check_pack(edge.docs(spark))
    check_pack(edge.docs(spark), window=64)
    assert packing.pack(edge.empty(spark)).count() == 0


def test_pack_real_has_no_padding(spark):
    _, padded = check_pack(spark.read.parquet(f"{SF}/documents.parquet"))
    assert padded == 0


TRICKY = ["don't it's. we'll 'tis d'accord l'été", "\u0130stanbul \u03a3\u0391\u03a3 \u03c2\u03c3 STRASSE straße",
          "H\u0331ello h\u0331ello J\u030c j\u030c e\u0301t\u00e9 E\u0301 \u00c9", "\u212bngstr\u00f6m \ufb01sh \u00bd \u00b2 x\u00b2 \u216b",
          "a1b2 1,234.56 x... ...x (y) [z]! ##* a_b __init__ <|endoftext|> <|startoftext|>x",
          "tab\there\u00a0nbsp\u0085nel\u2003em\u200bzero \x1c\x1d", "\U0001f600 smile\U0001f600 日本語 テキスト. 中文， mixed中文abc",
          "ALLCAPS Title mIxEd ÀÉÎ. Àé\u0301", "", " ", "\n\n", "word.\u0301x", "'", "''s 's s'", "supercalifragilisticexpialidocious." * 40]


def test_word_by_word_encoding_is_the_tokenizers_own():
    e = packing.WordEncoder(packing.default_vocabulary())
    assert e.by_word
    for _ in range(2):                       # also from memory
        for t in [*TRICKY, " ".join(TRICKY), "\n".join(TRICKY)]:
            assert np.frombuffer(e(t), "<u4").tolist() == whole_ids(t)[:-1], t


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert not e.by_word
    assert np.frombuffer(e("a  b\nc d"), "<u4").tolist() == t.encode("a  b\nc d", add_special_tokens=False).ids


def test_sum_of_squares_choice():
    """Every placement takes the choice with the smallest sum of squares."""
    rng = random.Random(3)
    p = packing.Packer(32)
    for k in range(4000):
        size = rng.randint(1, 32)
        before = p.counts.copy()
        p.place(k, size)
        if size == 32:
            assert (p.counts == before).all()
            continue
        options = []
        for h in [0, *np.flatnonzero(before)]:
            if h + size <= 32:
                c = before.copy()
                c[h] -= h > 0
                c[h + size] += h + size < 32
                options.append(int((c ** 2).sum()))
        assert int((p.counts ** 2).sum()) == min(options)
        assert all(len(a) == n for a, n in zip(p.at, p.counts))


def test_merged_windows_lose_nothing():
    rng = random.Random(5)
    for _ in range(200):
        windows, n = [], 0
        for _ in range(rng.randint(0, 9)):
            left, w = rng.randint(1, 63), []
            while left:
                s = rng.randint(1, left)
                w.append(((("d", n), 0), s))
                n += 1
                left -= s
            windows.append(w)
        windows.sort(key=lambda w: -sum(s for _, s in w))
        out = packing.merged(windows, 64)
        want = collections.Counter((d, i) for w in windows for (d, a), s in w for i in range(a, a + s))
        got = collections.Counter((d, i) for w in out for (d, a), s in w for i in range(a, a + s))
        assert got == want
        assert all((t := sum(s for _, s in w)) <= 64 and t & (t - 1) == 0 for w in out)


# ---- secrets ----------------------------------------------------------------

RANDOM = "xK9f2Qz7LmP4vT1bWc8RyJ3hNd6S"


def by_hand(text):
    return secrets.find(text, secrets.default_vocabulary())


def test_base_spans():
    assert by_hand('x PassWord = "abc123" y') == [("assign", 2, 20)]
    assert by_hand("password: token: abcdefgh") == []           # the first match has five characters and is used up
    assert by_hand("api_key:abcde") == [] and by_hand("apikey=abcdef")[0][:1] == ("assign",)
    assert by_hand("AKIA" + "A" * 15) == [] and by_hand("é AKIA" + "A" * 16) == [("access", 2, 22)]
    assert by_hand("g" + "a1" * 12 + "z") == [("hex", 1, 25)]
    assert by_hand("a" * 23) == []
    both = by_hand("token=" + "ab" * 20)
    assert both == [("assign", 0, 46), ("hex", 6, 46)]
    assert by_hand("to\u212aen=abcdef") == []                  # the Kelvin sign is no letter of the list


def test_random_strings_and_exclusions():
    assert by_hand(f"see {RANDOM} there") == [("random", 4, 4 + len(RANDOM))]
    for clean in ("123e4567-e89b-12d3-a456-426614174000", "ABCDEF0123456789ABCDEF0123456789".lower()[:16] + "-",
                  "internationalization2024", "2024-05-17-18-44-09-1234", "snake_case_identifier_name_2", "x" * 40,
                  "erschlichereinbelichheitung", "4111111111111111", "release-notes-2024-final-draft"):
        assert not [s for s in by_hand(f"a {clean} b") if s[0] == "random"], clean


def test_random_strings_are_found_and_words_left_alone():
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = sum(bool(by_hand("key " + "".join(rng.choices(alphabet, k=32)) + " end")) for _ in range(300))
    assert found >= 297


def test_random_letters_are_found_and_words_left_alone():
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for n in (16, 20, 24, 32):
        for tail in ("", "7", "42"):
            found = sum(bool(by_hand("key " + "".join(rng.choices(letters, k=n)) + tail + " end")) for _ in range(300))
            assert found >= 285, (n, tail)
    for clean in ("getElementsByClassName", "ArrayIndexOutOfBoundsException2", "uncharacteristically", "INTERNATIONALIZATION",
                  "Donaudampfschifffahrtsgesellschaft", "einpfauaueinchpf", "/usr/share/javaScript/nodeModules"):
        assert not by_hand(f"a {clean} b"), clean


def test_scan_and_redact(spark):
    from pyspark.sql import functions as F
    df = edge.docs(spark)
    assert all(r.s == [] for r in df.select(secrets.spans(F.col("text")).alias("s")).collect())
    assert collections.Counter(secrets.redact(df).collect()) == collections.Counter(
        r if r.text is None else type(r)(*r[:4], len(r.text), *r[5:]) for r in df.collect())
    assert secrets.redact(edge.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, f"a token='{RANDOM}' b AKIA{'Z' * 16} c", 5)], "doc_id long, text string, n_chars long")
    r = secrets.redact(one).first()
    assert r.text == "a <secret>' b <secret> c" and r.n_chars == len(r.text)


def test_query_matches_brute_force(spark):
    import hashlib
    from keyspan.llm.catalog import QUERIES
    got = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        s = by_hand(r.text)
        base = [x for x in s if x[0] != "random"]
        text = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(x[0] == k for x in s) for k in ("assign", "access", "hex"))
        assert g.spans == text(s) and g.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()


def test_digest_columns(spark):
    from keyspan.llm.catalog import QUERIES
    rows = QUERIES["op4_packing"](spark, SF).collect()
    docs = {r.doc_id: whole_ids(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        ids = np.asarray(docs[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(ids) and r.doc_tokens == len(docs[r.doc_id])


def test_special_tokens_are_encoded_as_the_tokenizer_does():
    """Against the contract's own call, also where special tokens touch words or blanks."""
    encoder = packing.WordEncoder(packing.default_vocabulary())
    for text in ("p <|endoftext|> q", "<|startoftext|>word<|endoftext|>", "a<|ENDOFTEXT|>b", "x <| y |> z", "a < b <|endof text|>",
                 "<|endoftext|>" * 3, "end <|endoftext|>\n\n more"):
        assert np.frombuffer(encoder(text), "<u4").tolist() == whole_ids(text)[:-1], text


def test_many_secrets_take_linear_time():
    import time
    path = secrets.default_vocabulary()
    one = "password = hunter2hunter2 and Xk9pQ2vLz8RtY4wB "
    took = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        assert len(secrets.find(one * n, path)) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]
