import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, extra=()):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = say(70)
    out = [say(r.randint(0, 160)) for _ in range(40)] + [f"{say(20)}\n{shared}\t{say(9)}" for _ in range(8)] + [shared] * 3
    near = say(120).split()
    for _ in range(5):
        w = list(near)
        w[r.randrange(120)] = "zz"
        out.append(" ".join(w))
    return [*out, None, "", " ", "x " * 400, "é" * 5000]


def plain_dedup(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    out = {}
    for i, w in enumerate(words):
        keep = [True] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                keep[p : p + k] = [False] * k
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out[i] = len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


@pytest.mark.parametrize("hot", [20_000, 60, 0])
def test_substring_dedup(spark, texts, hot):
    from tidewater.llm.substring_dedup import substring_dedup

    rows = substring_dedup(make(spark, texts, [(None, "a b c", None, None, None)]), hot_windows=hot).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert got.pop(None)[:2] == (3, 0)
    assert got == plain_dedup(texts, 50)
    assert sum(x[1] for x in got.values()) > 300
    assert substring_dedup(make(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [20_000, 100])
def test_substring_dedup_of_periodic_texts(spark, hot):
    """Texts of one period are runs of very many windows with one minimiser; they meet wherever they begin."""
    from tidewater.llm.substring_dedup import cut, substring_dedup

    r = random.Random(7)
    some = ["w " * 2000, "a b c " * 500, "x " + "b c a " * 300, "w " * 49, "w " * 50, "w " * 900 + " ".join(str(r.random()) for _ in range(300)), "a b c " * 17]
    rows = substring_dedup(make(spark, some), hot_windows=hot).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in rows} == plain_dedup(some, 50)
    start, count, key = cut(np.array([3, 900]), np.array([600, 5]), np.array([7, 8], np.uint64))
    assert (start.tolist(), count.tolist(), key.tolist()) == ([3, 259, 515, 900], [256, 256, 88, 5], [7, 7, 7, 8])


def plain_classes(texts):
    bags = []
    for t in texts:
        w = WORD.findall(t or "")
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return dict(enumerate(label))


def test_near_dedup(spark, texts):
    from tidewater.llm.near_dedup import near_dedup

    got = {r["doc_id"]: r["class_id"] for r in near_dedup(make(spark, texts, [(None, texts[0], None, None, None)])).collect()}
    assert got.pop(None) is None
    assert got == plain_classes(texts)
    assert near_dedup(make(spark, [])).count() == 0


def test_near_dedup_verifies_at_the_first_key_that_a_pair_shares(spark):
    """Texts 1 and 2 meet in their second band only, beside a less similar hub; of the first band's registers, just the mixed low bytes agree."""
    from tidewater.llm.near_dedup import near_dedup

    r = random.Random(9689)
    say = lambda n: [f"{r.randrange(10**6)}" for _ in range(n)]
    common, both = say(12), say(8)
    trio = [" ".join(x) for x in (common + say(12), common + both + say(4), common + both + say(4))]
    got = near_dedup(make(spark, trio), size=1, threshold=0.5, registers=2, bands=2).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {0: 0, 1: 1, 2: 1}


def test_near_dedup_of_families_without_a_centre(spark):
    """Near copies of a text that isn't there, and a chain of texts: most members miss the central text of a bucket."""
    from tidewater.llm.near_dedup import near_dedup

    r = random.Random(9)
    say = lambda n: ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    base, stream = say(300), say(900)
    family = []
    for _ in range(150):
        w = list(base)
        for p in r.sample(range(300), r.choice((2, 5, 7))):
            w[p] = "zz" + str(r.randrange(10**6))
        family.append(" ".join(w))
    chain = [" ".join(stream[i : i + 160]) for i in range(0, 700, 12)]
    some = [*family, *chain]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup(make(spark, some)).collect()}
    want = plain_classes(some)
    assert got == want and len({want[i] for i in range(150)}) > 1 and len({want[i] for i in range(150, len(some))}) == 1


def test_parity_bitmaps_never_exceed_the_symmetric_difference():
    from tidewater.llm.near_dedup import parities

    rng = np.random.default_rng(3)
    bags = [np.unique(rng.integers(-50, 5000, n)) for n in (5, 200, 900, 3000)]
    p = parities(np.concatenate(bags), np.array(list(map(len, bags))), 256)
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            assert np.abs(p[i] - p[j]).sum() <= len(np.setxor1d(a, b))


def test_signatures_estimate_weighted_jaccard():
    from tidewater.llm.near_dedup import signatures

    m = 4096
    row, item, weight = np.array([0, 0, 1, 1]), np.array([7, 9, 7, 8], np.uint64), np.array([10, 3, 6, 5])
    s = signatures(row, item, weight, 2, m)
    assert abs((s[0] == s[1]).mean() - 6 / (10 + 3 + 5)) < 0.03


def entropy(word):
    best = 0
    for p in range(len(word) - 19):
        c = Counter(word[p : p + 20])
        best = max(best, -sum(n / 20 * math.log2(n / 20) for n in c.values()))
    return best


def test_secrets(spark):
    from tidewater.llm.secrets import digest, find_secrets, largest_entropy, redacted

    texts = ['é API_KEY = "abcDEF123456" x', "password: secret = abcdefgh1", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2 + "0", "k aB3dE6gH9jK2mN5pQ8sT1 z", "example-aB3dE6gH9jK2mN5pQ8sT1", None, "", "a" * 50]
    rows = find_secrets(make(spark, texts)).select("doc_id", digest(F.col("base")).alias("b"), digest(F.col("spans")).alias("s"), redacted(F.col("text"), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [r["b"] for r in rows] == ["assign:2:25", "", "access:0:20", "hex:0:33", "", "", "", "", "hex:0:50"]
    key = "aB3dE6gH9jK2mN5pQ8sT1"
    assert rows[4]["s"] == f"entropy:{texts[4].index(key)}:{texts[4].index(key) + len(key)}" and rows[5]["s"] == ""
    assert rows[0]["t"] == 'é [SECRET]" x'
    words = ["aB3dE6gH9jK2mN5pQ8sT1xx", "a" * 20, "abcdefghijklmnopqrstuvwxyz", "0123" * 9]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(largest_entropy(F.col("w")).alias("e")).collect()
    assert [r["e"] for r in got] == pytest.approx([entropy(w) for w in words])
    r = random.Random(8)
    long = "".join(r.choice("ABCxyzabc0123456789") for _ in range(4000))
    rows = find_secrets(make(spark, [long, "a-" * 40_000 + "A1", "x " * 50_000])).orderBy("doc_id").select(digest(F.col("spans")).alias("s")).collect()
    assert [x["s"] for x in rows] == [f"entropy:0:{len(long)}", "", ""]
    assert find_secrets(make(spark, [])).count() == 0


def test_secrets_of_every_alphabet(spark):
    """Random keys of common alphabets are found, words and names aren't."""
    from tidewater.llm.secrets import find_secrets

    r = random.Random(11)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [digits + "abcdef", digits + lower, upper + "234567", digits + lower + upper, lower + upper]
    for a in alphabets:
        for n in (24, 40):
            keys = ["".join(r.choice(a) for _ in range(n)) for _ in range(60)]
            rows = find_secrets(make(spark, [f"the {k} key" for k in keys])).collect()
            assert sum(any((s["start"], s["stop"]) == (4, 4 + n) for s in x["spans"]) for x in rows) >= (48 if digits[2] not in a else 54), (a, n)
    clean = ["internationalizationalism antidisestablishmentarianism", "getElementsByTagNameAndClass HTTPSConnectionFactoryImpl", "some_long_snake_case_name_2024 kebab-case-title-of-a-page-12", "2024-01-02T03:04:05 20240102030405060708", "WELCOME_TO_THE_MACHINE_1975 a/path/to/a/file/of/some/kind.txt"]
    assert all(not x["spans"] for x in find_secrets(make(spark, clean)).collect())


def test_sentencepiece_matches_the_library(spark, texts):
    spm = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    from tidewater.llm.sentencepiece_fst import decode_documents, encode_documents

    path = tokenizers.path("piece_bpe_32k.model")
    r = random.Random(2)
    some = [*texts, "  two  spaces", "日本語 😀", "def f(x):\n\treturn x", *("".join(r.choice("abtheinr  .,'\né<0xA>") for _ in range(90)) for _ in range(40))]
    out = encode_documents(make(spark, some), path).orderBy("doc_id")
    library = spm.SentencePieceProcessor(model_file=path)
    rows = out.collect()
    assert [x["ids"] for x in rows] == [library.encode(t or "") for t in some]
    assert all(x["round_trip"] for x in rows)
    assert [x["text"] for x in decode_documents(out, path).orderBy("doc_id").collect()] == [t or "" for t in some]


def test_sentencepiece_query_returns_ids(spark, tmp_path):
    from tidewater.llm.queries import op4_sentencepiece_transducer

    make(spark, ["One two, three.", "é 12", ""]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op4_sentencepiece_transducer(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and all(len(r["ids"]) == r["n_ids"] for r in rows) and sum(r["n_ids"] for r in rows) > 0


def model_file(tmp_path, pieces, kind, rules=None, fallback=True, drop_spaces=False):
    """A model of hand-made pieces, and of the library's own character map of a name."""
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    if rules:
        m.ParseFromString(spm.SentencePieceNormalizer(rule_name=rules).serialized_model_proto())
        del m.pieces[:]
    m.normalizer_spec.remove_extra_whitespaces = drop_spaces
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    for text, score, kind in [("<unk>", 0.0, 2), *pieces, *([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])]:
        p = m.pieces.add()
        p.piece, p.score, p.type = text, score, kind
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    return str(path), spm.SentencePieceProcessor(model_file=str(path))


@pytest.mark.parametrize("rules", [None, "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [True, False])
def test_sentencepiece_of_other_models_matches_the_library(tmp_path, rules, kind, fallback):
    """Unigram and byte-pair models with character maps, extra spaces dropped, user-defined pieces, with and without bytes."""
    from tidewater.llm.sentencepiece_fst import Transducer

    r = random.Random(6)
    chars = "abcd1f▁"
    some = sorted({"".join(r.choice("abcd1f") for _ in range(r.randint(2, 4))) for _ in range(40)} | {"▁" + "".join(r.choice("abcd") for _ in range(r.randint(1, 3))) for _ in range(25)})
    pieces = [(c, -9.0 - i / 7, 1) for i, c in enumerate(chars)] + [(p, -2.0 - i / 13, 1) for i, p in enumerate(r.sample(some, len(some)))] + [("<tag>", 0.0, 4), ("da", 0.0, 4), ("<tag>x", 0.0, 4)]
    texts = ["", " ", "abcd", " ab  cd ab ", "ﬁ ①ａｂ Ａ１ dc", "ab<tag>cd <tag>x dada", "é xyz☃☃ 世界 ab", "a\u0301b e\u0308", "A B\tc\u00a0d", "ab" * 200] + ["".join(r.choice("abcd1f  éﬁ①<") for _ in range(r.randint(1, 80))) for _ in range(150)]
    for drop in (False, True):
        path, library = model_file(tmp_path, pieces, kind, rules, fallback, drop)
        m = Transducer.load(path)
        for t in texts:
            assert m.encode(t) == library.encode(t), (t, drop)
    with pytest.raises(ValueError):
        Transducer.load(model_file(tmp_path, pieces, 3)[0])


def test_sentencepiece_memories_are_bounded():
    from tidewater.llm.sentencepiece_fst import Transducer

    m = Transducer([("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -0.5, 1)], bpe=True)
    m.limit = 50
    r = random.Random(1)
    for _ in range(60):
        m.encode(" ".join("".join(r.choice("ab") for _ in range(r.randint(1, 200))) for _ in range(40)))
    assert len(m.parts) <= 51 and len(m.cache) <= 51 + 40


def test_unigram_shortest_path_matches_brute_force():
    from tidewater.llm.sentencepiece_fst import Transducer

    pieces = [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("ba", -2.9, 1), ("▁a", -3.2, 1), ("▁", -2.0, 1)]
    m = Transducer(pieces, bpe=False)

    def best(text):
        if not text:
            return 0.0, []
        return max((s + (rest := best(text[len(p) :]))[0], [i, *rest[1]]) for i, (p, s, k) in enumerate(pieces) if k == 1 and text.startswith(p))

    for text in ("abba", "a ab", "bab ba"):
        assert m.encode(text) == best(m.normalise(text))[1]


def test_binary_round_trip(spark, texts, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from tidewater.llm.binary_output import read_dataset, write_dataset

    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    some = [*texts, "It's THE end. <|endoftext|> a.́ b", "Mixed.Case, words; 1Ⅷ ﬁ"]
    got = {r["doc_id"]: r for r in read_dataset(spark, write_dataset(make(spark, some), path, str(tmp_path / "t"))).collect()}
    start = 0
    for i, x in enumerate(some):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()))
        start += len(ids)
    assert read_dataset(spark, write_dataset(make(spark, []), path)).count() == 0
    with pytest.raises(ValueError):
        write_dataset(make(spark, some), path, "hdfs://x/y")
    from tidewater.llm.binary_output import vocabulary_of, write_shard

    assert vocabulary_of(path) == 49_408
    with pytest.raises(ValueError):
        write_shard(str(tmp_path), 0, 2, iter([(1, np.array([70_000], np.uint32).tobytes())]))
    wide = write_dataset(make(spark, some), path, str(tmp_path / "wide"), end_id=70_000)
    assert sum(r["n_tokens"] for r in read_dataset(spark, wide).collect()) == sum(r["n_tokens"] for r in got.values())


def test_binary_output_encodes_words_together(monkeypatch):
    """A distinct word is encoded once whatever marks follow it, and plain words many at a time; ids are those of whole texts."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from tidewater.llm import binary_output as bo

    class Counting:
        def __init__(self, tokenizer):
            self.inner, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **more):
            self.texts += texts
            return self.inner.encode_batch_fast(texts, **more)

    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    r = random.Random(2)
    words = ["".join(r.choice("abcdeéßñü") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    texts = [" ".join(w + r.choice(["", ".", "###", "&&&,", "'", ">)", "$"]) for w in r.choices(words, k=400)) for _ in range(40)]
    odd = [None, "", " \t", "\x0b a\x0cb\r\n", "<|endoftext|> <|ENDOFTEXT|> x<|endoftext|>, <|endoftext|>>", "it's IT'S rock' 'll x'll, 'S", "É é ÉÉ. ª µ º ÷ a÷b", "e\u0301 e\u0301. a\u0338 ab\u0338! x<\u0338 <", "a1 1a 12,34 a\u00a0b a\u2028b \x1c c\x85d", "中文。 ก็ 😀a😀 \x00 \x00a"]
    bo.word_encoder(path)
    tokenizer, final, known, cores = bo._caches[path]
    for marks in (final, frozenset(), frozenset(list(final)[::2])):  # no marks, or wrong ones: one by one
        known.clear()
        cores.clear()
        monkeypatch.setitem(bo._caches, path, (count := Counting(tokenizer), marks, known, cores))
        for some in (texts, odd, odd[2:3], [None], []):
            for kind in (pa.string(), pa.large_string()):
                ids, bounds = bo.word_encoder(path)(pa.array(["x", *some], kind).slice(1))
                assert [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:], strict=False)] == [t.encode(x or "", add_special_tokens=False).ids for x in some]
        assert marks != final or len(count.texts) < 100 < sum(len(x.split()) for x in count.texts)


def test_decontamination(spark):
    from tidewater.llm.decontaminate import align, decontaminate, without_contaminated

    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [say(25), say(40), "tiny", None]
    edited = list(items[0].replace(" ", "; ").upper())
    for p in (30, 71, 90):
        edited[p] = "q"
    texts = [say(100), f"{say(50)} {items[1]} {say(10)}", "".join(edited), say(20) + items[0][: len(items[0]) // 2], None, "", items[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (16_000_000, 100):
        got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontaminate(make(spark, texts), bench, index_bytes=size).collect()}
        assert set(got) == {(1, 1), (2, 0), (6, 1)} and got[1, 1] == 0
    kept = without_contaminated(make(spark, texts), bench)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 3, 4, 5]

    def edits(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0] = range(len(a) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        return d[-1].min()

    for _ in range(100):
        a = np.frombuffer(bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))), np.uint8)
        b = np.frombuffer(bytes(r.choice(b"abc") for _ in range(r.randint(1, 15))), np.uint8)
        assert align(a, b, -len(a), len(b), 100) == edits(a, b)


def test_decontamination_counts_the_same_in_parts():
    """Bands from pairs counted a few at a time equal those counted at once, also for q-grams that all passages hold."""
    from tidewater.llm import decontaminate as d

    r = random.Random(2)
    items = [(i, "abc" * 30 + "".join(r.choice("abcde") for _ in range(40))) for i in range(12)] + [(20, "z" * 60)]
    ix = d.build(items, 0.08, 40)
    text = ("abc" * 50 + items[3][1] + "z" * 200).encode()
    body, bounds, _ = d.normalise(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    h = d._hashes(body)
    gram = np.minimum(np.searchsorted(ix.grams, h), len(ix.grams) - 1)
    hits = np.flatnonzero(ix.grams[gram] == h)
    row = np.zeros(len(hits), np.int64)
    for shift in (0, 1):
        whole = sorted(d._bands(ix, hits, gram[hits], row, shift))
        assert whole and whole == sorted(d._bands(ix, hits, gram[hits], row, shift, limit=37))


def test_decontamination_equals_alignment_of_all_pairs(spark):
    """Copies with random edits up to and beyond the budget, against the least edits of each passage in each text."""
    from tidewater.llm.decontaminate import align, build, decontaminate, normalise

    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [say(r.randint(9, 30)) for _ in range(12)]
    texts = []
    for i in range(60):
        copy = list(r.choice(items))
        for _ in range(r.randint(0, 14)):
            p, kind = r.randrange(len(copy)), r.randrange(3)
            copy[p : p + 1] = [[], [r.choice("qrst")], [copy[p], r.choice("qrst")]][kind]
        texts.append(f"{say(r.randint(0, 40))} {''.join(copy)} {say(r.randint(0, 10))}")
    ix = build(list(enumerate(items)), 0.08, 40)
    plain = lambda t: normalise(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    want = {}
    for i, t in enumerate(texts):
        body = plain(t)
        for item, e in zip(ix.items, ix.edits.tolist(), strict=True):
            found = align(ix.bodies[ix.items.index(item)], body, -len(ix.bodies[ix.items.index(item)]), len(body), e)
            if found <= e:
                want[i, item] = found
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontaminate(make(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == want and 20 < len(want) < 60 and any(want.values())


def test_decontamination_by_short_items(spark):
    from tidewater.llm.decontaminate import decontaminate, without_contaminated

    items = ["Who wrote Emma?", "What is 2+2", "世界上最高的山是什么山呢吗", "ok", "...", "Who wrote Emma?"]
    texts = ["he said: who  wrote EMMA, once", "who wrote emmas", "xwho wrote emma", "who wrote", "emma", "a what is 22", "我问世界上最高的山是什么山呢吗你说", "look", "“OK”", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (16_000_000, 20):
        rows = decontaminate(make(spark, texts), bench, index_bytes=size).collect()
        assert {(x["doc_id"], x["item_id"], x["edits"]) for x in rows} == {(0, 0, 0), (0, 5, 0), (5, 1, 0), (6, 2, 0), (8, 3, 0)}
    assert {(x["start"], x["stop"]) for x in rows if x["doc_id"] in (0, 6)} == {(9, 24), (2, 15)}
    assert sorted(x["doc_id"] for x in without_contaminated(make(spark, texts), bench).collect()) == [1, 2, 3, 4, 7, 9, 10]


def test_toxicity(spark):
    from tidewater.llm.toxicity import fit_toxicity, score_toxicity

    r = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        w = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(r.randint(1, 60))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(["horridle", "xhorrid", "horrid"])
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    docs = make(spark, [*texts, None, "", "a horridz thing"])
    model = fit_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    rows = {x["doc_id"]: x["score"] for x in score_toxicity(docs, model).collect()}
    assert np.mean([(rows[i] >= 0.5) == y for i, y in labels if i % 5 == 0]) > 0.95
    assert rows[402] > 0.5 > rows[400] == rows[401]
    none = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert score_toxicity(docs, none).where("score > 0.01").count() == 0


def test_toxicity_of_long_and_repeated_texts(spark):
    """A long clean text stays clean, one with a passage doesn't; the sample's limits hold for rows and bytes."""
    from tidewater.llm.toxicity import fit_toxicity, pooled, score_toxicity

    r = random.Random(4)
    say = lambda n: ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(n)]
    texts = [" ".join([*say(r.randint(5, 60)), *([r.choice(("horridle", "xhorrid"))] * (i % 4 == 0)), *say(5)]) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    long = say(60_000)
    some = make(spark, [*texts, " ".join(long), " ".join([*long, *["horrid"] * 30]), " ".join(long * 2)])
    model = fit_toxicity(some, labels, F.lit(True))
    some = some.withColumn("__text", F.lit(1)).withColumn("__score", F.lit(2)).withColumn("a.b", F.lit(3))
    out = score_toxicity(some, model)
    assert out.columns == [*some.columns, "score"]
    rows = {x["doc_id"]: x["score"] for x in out.collect()}
    assert rows[400] < 0.5 < rows[401] and rows[402] == pytest.approx(rows[400], abs=0.01)
    twice = make(spark, texts).union(make(spark, texts))
    assert np.array_equal(fit_toxicity(twice, labels, F.lit(True), sample_rows=40).logit, fit_toxicity(twice.repartition(3), labels, F.lit(True), sample_rows=40).logit)
    assert not fit_toxicity(twice, labels, F.lit(True), sample_bytes=10).logit.any()
    z = np.array([1.0, -2.0, 0.5, 3.0])
    logit, part = pooled(z, np.array([0, 1, 1, 1]), 2)
    assert logit == pytest.approx([1.0, math.log(sum(map(math.exp, z[1:])) / 3 * 2)]) and part[1:].sum() == pytest.approx(1)


def test_toxicity_bounds_the_memory_of_new_words(spark):
    """Text full of words that a worker has not met takes little memory beside the text, and each text is sent to it once."""
    import tracemalloc

    import pyarrow as pa

    from tidewater.llm.toxicity import Classifier, _known, _score, score_toxicity

    class Shared:
        value = Classifier(np.random.default_rng(0).normal(size=1 << 12), 0.25, 2, (3, 5, 7, 9), 200)

    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(100)) for _ in range(700)]
    _known.clear()
    tracemalloc.start()
    few = [x for b in _score(Shared, "score", 1)(iter([pa.record_batch([pa.array(range(700)), pa.array(texts)], ["c0", "c1"])])) for x in b.column(2).to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 70_000_000
    tracemalloc.stop()
    _known.clear()
    many = [x for b in _score(Shared, "score", 1, part=10**9)(iter([pa.record_batch([pa.array(range(700)), pa.array(texts)], ["c0", "c1"])])) for x in b.column(2).to_pylist()]
    assert few == many
    _known.clear()
    docs = make(spark, ["a b", None, "c"])
    sent = score_toxicity(docs, Shared.value)
    assert len(re.findall(r"text#\d+ AS", sent._jdf.queryExecution().optimizedPlan().toString())) <= 1
    over = {r["doc_id"]: r["TEXT"] for r in score_toxicity(docs, Shared.value, score_col="TEXT").collect()}
    assert over == {r["doc_id"]: r["score"] for r in sent.collect()} and sent.columns == [*docs.columns, "score"]


def test_language_model(spark, texts):
    from tidewater.llm.lm import lm_score, tables

    rows = lm_score(make(spark, texts), F.col("doc_id") % 7 == 2, head=20, classes=12, buckets=9).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if i % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    rng = np.random.default_rng(0)
    params = [rng.normal(size=s) for s in ((6, 3), (6, 3), (3, 3), (3, 3), (5, 3), (5,))]
    one, two, bias, norm = tables(params)
    assert np.allclose(np.exp(one[:, None] + two[None] + bias - norm[..., None]).sum(axis=-1), 1, atol=1e-4)
    assert lm_score(make(spark, []), F.lit(False)).count() == 0


def test_language_model_is_one_whatever_the_split(spark):
    """Scores don't depend on partitions; in each context all words and the buckets' unknowns have a probability of 1 in sum; order is learnt."""
    from tidewater.llm import lm

    r = random.Random(3)
    follow = {i: [r.randrange(60) for _ in range(3)] for i in range(60)}
    texts = []
    for _ in range(300):
        w, out = r.randrange(60), []
        for _ in range(r.randint(5, 60)):
            out.append(f"W{w}" if r.random() < 0.5 else f"w{w}")
            w = r.choice(follow[w])
        texts.append(" ".join(out))
    df = make(spark, [*texts, None, "", texts[0]], [(None, "w1 w2", None, None, None), (None, None, None, None, None)])
    options = {"head": 50, "classes": 30, "buckets": 7, "shard_tokens": 2000, "batch": 256, "rate": 0.2}
    found = []
    for parts in (1, 6):
        rows = lm.lm_score(df.repartition(parts), F.col("doc_id") % 7 == 2, **options).collect()
        found.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6)) for r in rows))
        held = [r for r in rows if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)
    assert found[0] == found[1]
    words = np.array([f"w{i}" for i in range(60)] + ["unknown"])
    flat = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    h = np.array([x for x in lm._tokens(np.frombuffer(flat, np.uint8), np.concatenate([[0], ends]))[0] if x != lm.END])
    assert len(h) == 61 and set(lm.bucket(h, 7)) <= set(range(7))


def test_language_model_sends_parameters_not_tables(spark, monkeypatch):
    """What the driver sends doesn't grow with the square of the classes, and the tables take little beside themselves."""
    import pickle
    import tracemalloc

    from tidewater.llm import lm

    sent = []
    whole = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(len(pickle.dumps(value))), whole(self, value))[1])
    rows = lm.lm_score(make(spark, ["a b a c", "b a", "c a b"]), F.col("doc_id") == 1).collect()
    assert len(rows) == 3 and sent and max(sent) < 1_000_000
    params = lm.start_parameters(np.log(np.full(1000, 1e-3)), 16, 5)
    tracemalloc.start()
    try:
        found = lm.tables(params, 128)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * sum(x.nbytes for x in found)
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(found, lm.tables(params, 10_000), strict=True))


def test_means_of_states_by_a_tree(spark):
    from tidewater.llm import lm

    rng = np.random.default_rng(0)
    states = {i: (int(rng.integers(0, 50)), rng.normal(size=5).astype(np.float32)) for i in range(0, 300, 3)}
    df = spark.createDataFrame([(i, n, bytearray(x.tobytes())) for i, (n, x) in states.items()], lm._STATE)
    n, mean = lm.mean_state(df, 300, fan=4)
    assert n == sum(k for k, _ in states.values()) and np.allclose(mean, sum(k * x for k, x in states.values()) / n, atol=1e-5)
    assert lm.mean_state(df.limit(0), 300) is None


def test_top_k(spark):
    from tidewater.llm.topk_search import top_k

    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in top_k(df, F.col("vec_id") % 20 == 0, k=7, block=16, group=64, batch=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:7]
        assert sorted(found) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


@pytest.mark.parametrize("size", [0.3, 1e6, 1e9])
def test_top_k_of_repeated_ids_null_ids_and_large_values(spark, size):
    """Each row but the query's own is a candidate, whatever its id; sums beyond floats stay exact, beyond 64 bits they saturate."""
    from tidewater.llm.topk_search import top_k

    rng = np.random.default_rng(1)
    rows = [(20 * (i // 3) if i < 30 else i, rng.normal(0, size, 6).tolist()) for i in range(90)] + [(None, rng.normal(0, size, 6).tolist()) for _ in range(5)]
    rows += [(7000, rows[0][1]), (7020, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(math.floor(64 * v)) for v in vector] for _, vector in rows]
    info = np.iinfo(np.int64)
    score = lambda a, b: min(info.max, max(info.min, sum(p * q for p, q in zip(a, b, strict=True))))
    want = Counter()
    for i, (q, _) in enumerate(rows):
        if q is not None and q % 20 == 0:
            best = sorted((-score(x[i], x[j]), c is None, c or 0) for j, (c, _) in enumerate(rows) if j != i)[:9]
            want.update((q, n, None if null else c, -s) for n, (s, null, c) in enumerate(best, 1))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 20 == 0, k=9, block=8, group=32, batch=4).collect())
    assert got == want


def test_top_k_prunes_blocks_of_like_vectors():
    from tidewater.llm.topk_search import Rows, search_block

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (64, 16))
    x = np.floor(64 * (np.repeat(centres, 64, axis=0) + rng.normal(0, 0.05, (4096, 16)))).astype(np.int64)
    ids = np.arange(4096)
    rows = Rows(ids, ids, np.zeros(4096, bool), ids % 20 == 0, x)
    q = Rows(*(c[rows.asks] for c in rows))
    who, at, score, floors, scored, every = search_block(q, rows, np.full(len(q.uid), np.iinfo(np.int64).min), 20, 64)
    assert scored < 0.2 * every
    full = q.x @ x.T
    full[np.arange(len(q.uid)), q.uid] = -(1 << 62)
    for i in range(len(q.uid)):
        want = sorted(zip(-full[i], ids, strict=True))[:20]
        assert sorted(zip(-score[who == i], at[who == i], strict=True)) == want and floors[i] == -want[-1][0]


def test_html(spark):
    from tidewater.llm.html_text import extract_text

    page = lambda i: f"<html><head><title>t</title></head><body><nav><a>m{i}</a></nav><div class=box><p>same on all pages</p></div><div><h1>T{i} &amp; U</h1><p><b>One{i}<br>two &lt;x&gt;<p>three\n four {i * 7}</div><div class='comments'>nice</div><script>var a='<p>';</script><footer>f{i}</footer>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(90, None, None), (91, "http://x.example", ""), (92, "x", "<article><p>a<ul><li>b<li>c</ul><form>no</form>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (500_000, -1):
        got = {r["page_id"]: r for r in extract_text(df, broadcast_nodes=limit).collect()}
        for i in range(12):
            assert got[i]["text"] == f"T{i} & U\nOne{i} two <x>\nthree four {i * 7}" and got[i]["n_chars"] == len(got[i]["text"])
        assert (got[90]["text"], got[91]["text"], got[92]["text"]) == ("", "", "a\nb\nc")
    deep = "<div>" * 3000 + "low<b>" * 3000 + "est"
    rows = extract_text(spark.createDataFrame([(1, None, deep), (1, None, deep), (None, "u", "a" * 300_000)], "page_id long, url string, html string").withColumn("text", F.lit(7))).collect()
    assert sorted(r["n_chars"] for r in rows) == [9003, 9003, 300_000]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_what_only_looks_like_boilerplate():
    from tidewater.llm.html_text import main_text, parse

    cases = {
        '<div class="post-header"><h1>Title</h1></div><p>a': "Title\na",
        '<section id="search-results"><p>found</section>': "found",
        '<div id="page-header"><p>x</div><div class="site-header"><h1>T</h1></div>b': "T\nb",
        '<div class="Sidebar left"><p>x</div><div class="cookie-notice">x</div><div class="ad-slot">x</div>c': "c",
        "<div/>d<p>e</div>f": "d\ne\nf",
        "<article><header><h1>T</h1></header>g<footer>x</footer></article><article class=comment>x</article>": "T\ng",
        "<p>a&nbsp;b &lt;i&gt; &#x41;<br>c<script>x</script>": "a b <i> A c",
        "<table><tr><td>1<td>2</table>": "1 2",
        "<p>open <b>bold <i": "open bold",
    }
    for source, want in cases.items():
        assert main_text(parse(source)) == want, source


def test_html_style_tree(spark):
    """Boilerplate without a telling tag or class, of a few variants; articles that were crawled with several menus."""
    from tidewater.llm.html_text import CONTENT, extract_text, judged_nodes, node_facts, parse

    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    menus, foot = [[say(1) for _ in range(5)] for _ in range(6)], [say(7) for _ in range(5)]
    rows, want = [], []
    for i in range(90):
        body = [say(40) for _ in range(r.randint(1, 4))]
        for _ in range(2 if i % 3 == 0 else 1):
            menu = "".join(f"<li><a href=x>{x}</a>" for x in r.choice(menus))
            page = f"<div class=u><ul>{menu}</ul></div><div class=v><h1>{body[0][:9]}</h1>{''.join(f'<p>{x}</p>' for x in body)}<div><p>Tell your friends</p></div></div><div class=w>{r.choice(foot)}</div>"
            rows.append((len(rows), f"https://h.example/{i}", page))
            want.append("\n".join([body[0][:9], *body]))
    few = (len(rows), "https://other.example/", "<div class=u><ul><li>a</ul></div><p>b")
    df = spark.createDataFrame([*rows, few], "page_id long, url string, html string")
    for limit in (200_000, -1):
        got = {x["page_id"]: x["text"] for x in extract_text(df, broadcast_nodes=limit).collect()}
        assert [got[i] for i in range(len(rows))] == want and got[len(rows)] == "a\nb"
    pages = defaultdict(dict)
    for _, _, source in rows:
        facts = list(node_facts(parse(source, "h.example")))
        pages[tuple((n, v) for n, kind, v, _ in facts if kind == CONTENT)] = facts
    contents, seen = defaultdict(Counter), defaultdict(set)
    for page, facts in pages.items():
        for n, kind, v in {f[:3] for f in facts}:
            seen[n].add(page)
            if kind == CONTENT:
                contents[n][v] += 1
    judged = {x["node"]: x for x in judged_nodes(df.select("url", "html"), 8, 0.85).collect()}
    assert len(judged) >= 4
    for n, x in judged.items():
        c = contents[n]
        mean = sum(k * math.log(k) for k in c.values()) / sum(c.values()) if c else 0.0
        assert x["own"] == pytest.approx(1 - mean / math.log(len(seen[n])))


def test_components(spark):
    from tidewater.llm.graph import components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    for limit in (500_000, 0):
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), limit).collect()}
        assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[150] == got[200] == 100


def test_pipeline_keeps_other_columns(spark, texts):
    """Columns of any name pass every stage; a table without n_chars too; of two texts of one id just the copy goes."""
    import corpus_pipeline

    rows = make(spark, [texts[3], texts[3], 'x token = "abcdefgh12345678" y']).drop("n_chars").withColumn("a.b", F.col("doc_id")).withColumn("toxic_score", F.lit("x"))
    rows = rows.unionByName(rows.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long")))
    kept = corpus_pipeline.near_duplicates(spark, rows, "")
    assert kept.columns == rows.columns and sorted((r["doc_id"], r["text"][:2]) for r in kept.collect()) == [(0, texts[3][:2]), (1, "x ")]
    clean = corpus_pipeline.secret_scan(spark, rows, "")
    assert clean.columns == rows.columns and clean.where("text like '%abcdefgh%'").count() == 0 and clean.where("`a.b` is not null").count() == 4
    from tidewater.llm.decontaminate import without_contaminated

    none = without_contaminated(rows, spark.createDataFrame([(1, "zz " * 40)], "item_id long, text string"))
    assert none.columns == rows.columns and none.count() == 4


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from tidewater.llm.scratch import drop, materialize, scratch_root

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch_root(Session())
    table = materialize(spark.range(5), "gone")
    assert table.count() == 5
    drop(table)
    with pytest.raises(Exception, match="(?i)path|file"):
        table.collect()


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    make(spark, [*texts, 'token = "abcdefgh12345678"']).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    classes = plain_classes(texts)
    assert set(rows) == {i for i, c in classes.items() if i == c and i != 3} | {len(texts)}


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    """Tables of nulls, repeated rows, empty and long texts and columns of clashing names; or the same without rows."""
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, t, None, None, None), (1, t, None, None, None), (1, t + " mu", None, None, None), (2, None, None, "s", None), (3, "", None, None, 0)]
    docs += [(None, t, "en", None, 9), (None, None, None, None, None), (4, "é" * 100_000, None, None, None), (5, "w " * 100_000, None, None, None), (6, 'token = "abcdefgh12345678" 😀', None, None, 40), (7, t, "de", "s", 1)]
    made = {
        "documents": spark.createDataFrame(docs, DOCS),
        "labels": spark.createDataFrame([(1, None, 0), (1, None, 0), (2, 1, 0), (None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None), (None, "abc"), (2, "zz " * 40), (2, "zz " * 40), (3, "")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(20, [1.0, 2.0], None), (20, [1.0, 2.0], None), (40, None, 1), (None, [1.0, 1.0], 2), (41, [1.0, 1.0], 2)], "vec_id long, embedding array<float>, label int"),
        "pages": spark.createDataFrame([(1, None, None), (None, "http://a/b", "<p>x"), (1, "a", "<p>x"), (1, "a", "<p>x")], "page_id long, url string, html string"),
    }
    folder = tmp_path_factory.mktemp(request.param)
    for name, df in made.items():
        for c in "n spans base __row class_id kept_text score held_out bands node start stop id y tail uid h c mh label key a b row rank vector asks page doc_id text".split():
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        (df if request.param == "odd" else df.limit(0)).write.parquet(f"{folder}/{name}.parquet")
    return request.param, str(folder)


# Of the 11 documents the pipeline drops 7 alone, a copy of 1: rows that share an id stay together, those without one stay.
ROWS = {"op6_html_extraction": 4, "op7_benchmark_decontamination": 0, "op10_topk_search": 6, "pipeline": 10}


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)] + ["pipeline"])
def test_odd_and_empty_tables(spark, tables, name):
    import __spark_entry__

    kind, folder = tables
    name, query = next((k, f) for k, f in __spark_entry__.queries().items() if k.startswith(name))
    rows = query(spark, folder).collect()
    assert len(rows) == (ROWS.get(name, 11) if kind == "odd" else 0)
    if kind == "odd" and name == "pipeline":
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 1, 1, 1, 2, 3, 4, 5, 6]
