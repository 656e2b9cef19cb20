"""Corpus operators against libraries, brute force and held-out rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dockmill.llm import bpe, exact_dedup, html_extract, language, packing, pii, queries, simhash
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, hot_name long, shard int"
ODD = [
    (1, None, "en", "a", 0, "x", 1, 1), (2, "", None, None, None, None, None, None), (3, "  \n ", "en", "", 4, "x", 1, 1), (4, "the Same text here", "en", "a", 4, "x", 1, 1),
    (5, "The same TEXT here", "en", "a", 4, "x", 1, 1), (5, "The same TEXT here", "en", "a", 4, "x", 1, 1), (None, "the same text here", "de", "b", 4, "x", 1, 1),
    (7, "word " * 30000, "en", "a", 4, "x", 1, 1), (8, "word " * 29999 + "last", "en", "a", 4, "x", 1, 1), (9, "ÄÖ straße 日本 \U0001f642", "de", "a", 4, "x", 1, 1), (10, "<|endoftext|> it's", "en", "a", 4, "x", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    coder, library, rng = bpe.BytePairCoder(path), Tokenizer.from_file(path), random.Random(5)
    library.no_truncation(), library.no_padding()
    signs = "ab cd  \t\n\x0b\x1c\x85\xa0\u2003'sté日🙂٣Ⅷ²%%%###<|endoftext|>.,!\u200b\x00"
    for text in ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [t[1] or "" for t in ODD]:
        want = library.encode(text, add_special_tokens=False).ids
        said = coder.encode_text(text)
        assert [int(x) for x in said.split(",") if x] == want
        assert coder.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, odd, none):
    rows = bpe.encode_decode(odd, bpe.default_vocabulary()).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((t[1] or "").encode()).hexdigest() for t in ODD)
    assert bpe.encode_decode(none, bpe.default_vocabulary()).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack_documents(odd, packing.default_vocabulary()).collect()
    check_packing(rows, 2048)
    lengths = sorted(len(library.encode(t[1] or "", add_special_tokens=False).ids) + 1 for t in ODD)
    totals = sorted(sum(r.length for r in rows if (r.doc_id, r.piece) == (i, 0)) for i in {t[0] for t in ODD})
    assert sum(r.length for r in rows) == sum(lengths) and all(r.start == r.piece * 2048 for r in rows) and totals
    assert packing.pack_documents(none, packing.default_vocabulary()).count() == 0


def test_packing_reaches_the_bound():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in np.minimum(2048, rng.lognormal(6, 1, 3000))]
    bins, offsets, _ = packing.pack(lengths)
    assert len({*bins}) <= 1.01 * -(-sum(lengths) // 2048) + 1
    assert max(o + n for o, n in zip(offsets, lengths, strict=True)) <= 2048


def test_exact_duplicates(spark, odd, none):
    rows = exact_dedup.exact_duplicates(odd).collect()
    groups = {}
    for i, t, *_ in ODD:
        groups.setdefault(lower(t), []).append(i)
    want = sorted((str(i), str(max(g, key=lambda x: (x is not None, x or 0))), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_exact_query_equals_oracle(spark):
    assert compare(queries.QUERIES["op5_exact_dedup"](spark, SF), connect(SF), queries.ORACLE_SQL["op5_exact_dedup"]) == ""


def brute_fingerprint(text):
    words = lower(text).encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, fps, radius=3):
    f = np.array(fps, np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= radius), strict=True):
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    least = {}
    for k, i in enumerate(ids):
        least.setdefault(find(k), []).append(i)
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_simhash_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = sorted(zip((d.doc_id for d in docs), (f"{f:016x}" for f in fps), brute_components([d.doc_id for d in docs], fps), strict=True))
    assert sorted(tuple(r) for r in queries.QUERIES["op2_simhash"](spark, SF).collect()) == want


def test_links_are_complete(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {tuple(sorted(r)) for r in simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == want


def test_thresholds_are_unequal_and_enough():
    for parts in (2, 3, 4):
        limits, _ = simhash.allocate([64 // parts] * parts, [[10.0 ** (k + 1) * 2**t for t in range(4)] for k in range(parts)])
        assert sum(limits) == 3 - parts + 1


def test_simhash_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in rows})
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    silent = F.lit(None).cast("string")
    found = language.identify(held, model, text=F.col("text"), declared=silent, host=F.col("source"), address=silent)
    assert found.where("__language = lang").count() >= 0.98 * held.count()


def test_language_evidence(spark, odd, none):
    texts = {"en": ["the house and the garden of this man"] * 5, "de": ["das haus und der garten von diesem mann"] * 5}
    model = language.TextModel(texts)
    rows = [(1, "the garden and the house", "", "x.example.com", ""), (2, "der garten und das haus", None, None, None), (3, "", "en", "x.example.com", ""), (4, "garten garden", "de", "y.example.org", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, address string")
    found = language.identify(df, model, text=F.col("text"), declared=F.col("declared"), host=F.col("host"), address=F.col("address"))
    assert {r.doc_id: r["__language"] for r in found.collect()} == {1: "en", 2: "de", 3: "und", 4: "de"}
    kept = language.keep_known_language(odd)
    assert kept.columns == odd.columns
    assert language.keep_known_language(none).count() == 0


def test_html_on_pages(spark):
    import re

    model = html_extract.trained()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, page in zip(html_extract.extract_text(pages, model).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub("<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    held = html_extract.training_pages(200, 77)
    said = model.predict([html_extract.leaf_blocks(p) for p, _ in held])
    assert np.mean(np.concatenate([(s >= 0.5) == np.array(y) for s, (_, y) in zip(said, held, strict=True)])) > 0.98
    strange = [(1, "u", None), (2, None, ""), (3, "u", "<div"), (3, "u", "<p>a<p>b</div></b>" * 3), (4, "u", "x" * 200000), (5, "u", "<a b='\" <c>" * 50)]
    rows = html_extract.extract_text(spark.createDataFrame(strange, "page_id long, url string, html string"), model).collect()
    assert len(rows) == 6 and all(r.text == "" for r in rows if r.page_id in (1, 2))
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_leaf_blocks():
    got = html_extract.leaf_blocks("<ul><li>a &amp; <b>b</b><li>c<br>d</ul><!-- <p>x</p> --><script>'<p>'</script>e")
    assert [(t, p[-1:]) for p, t, _ in got] == [("a & b", ["li"]), ("c d", ["li"]), ("e", [])]


def test_pii_patterns_equal_plain_search():
    import re

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    def plain(t):
        out = [(m.start(), m.end(), 0) for m in email.finditer(t)] + [(m.start(), m.end(), 1) for m in ip.finditer(t) if all(int(p) < 256 for p in m[0].split("."))]
        out += [(m.start(), m.end(), 2) for m in card.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return sorted(out + [(m.start(), m.end(), 3) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15], key=lambda s: (s[0], s[2], s[1]))

    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("a@.1 2-+()9b_%é\n5.") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain(t)


def test_pii_model_and_rows(spark, odd, none):
    model = pii.train()
    held = pii.labelled_table(200, 77)
    said = [pii.LABELS[x] for path in model.decode([w for w, _ in held]) for x in path]
    want = [y for _, labels in held for y in labels]
    assert sum(a == b for a, b in zip(said, want, strict=True)) / len(want) > 0.98
    text = 'Mail a.b1@mail.example.com now. 4111111111111111 5500005555555559 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    ((own, every),) = pii.find_spans([text], model)
    assert [k for *_, k in own] == [0] and {k for *_, k in every} == {0, 2, 4}
    assert pii.masked(text, every) == 'Mail [EMAIL] now. [CARD] [CARD] token = "[SECRET]" end'
    rows = pii.find_personal_data(odd, model).collect()
    assert len(rows) == len(ODD) and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    masked = pii.mask_documents(odd, model)
    assert masked.columns == odd.columns and masked.where("text is null").count() == 1
    assert pii.find_personal_data(none, model).count() == 0 and pii.mask_documents(none, model).count() == 0


def five_words(text):
    words = lower(text).encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard_components(ids, sets):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(zip(ids, sets, strict=True)):
        for j, b in zip(ids[:k], sets[:k], strict=True):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in ids]


def test_pipeline_equals_brute_force(spark):
    """The near stage's terms are those of all stages on word shingles: five words, similarity 0.8."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = pii.train()
    kept = {}
    for d in sorted((d for d in docs if (d.text or "").strip()), key=lambda d: d.doc_id):
        kept[lower(d.text)] = d
    rest = sorted(kept.values(), key=lambda d: d.doc_id)
    roots = jaccard_components([d.doc_id for d in rest], [five_words(d.text) for d in rest])
    rest = [d for d, r in zip(rest, roots, strict=True) if d.doc_id == r]
    texts = [pii.masked(d.text, every) for d, (_, every) in zip(rest, pii.find_spans([d.text for d in rest], model), strict=True)]
    coder = packing.WordTokenizer(packing.default_vocabulary())
    want = sorted((d.doc_id, len(ids) // 4 + 1) for d, ids in zip(rest, coder.ids(texts), strict=True))
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, 2048)
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert sorted(got.items()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
