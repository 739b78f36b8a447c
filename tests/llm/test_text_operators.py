"""Text operators against brute force, on small fixtures with nulls, ties, repeats, empty and very long texts."""

import base64
import hashlib
import math
import random
import re
import struct
import textwrap
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from airlake.llm import bpe, embedding_dedup, exact_dedup, licenses, minhash, packing, quality, shingles, substring_dedup, toxicity, warc
from airlake.llm.common import connected_components, Scratch, tune_bands

WORDS = "alpha beta gamma delta rain snow wind cloud river stone leaf root bark moss fern pine oak ash elm fir".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"x{rng.random()}"[:9].replace(".", "") if rng.random() < share else w for w in text.split())


def multiset(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    x, y = multiset(a), multiset(b)
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


ODD = [None, "", " \t\n", "one", "One two", "é ü ñ — 漢字 😀", "a " * 3000, "z" * 20000]


def test_exact_dedup(spark, make_docs):
    texts = [*ODD, "a b c", "abc", "a  bc", "ab c\n", "abc", "A b c", *["same text"] * 40, "same  text"]
    rows = list(enumerate(texts)) + [(3, "one"), (None, "one"), (None, None)]
    got = exact_dedup.exact_dedup(make_docs(rows).repartition(7), fan_in=2).collect()
    assert len(got) == len(rows)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0))
    keep = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in groups.items()}
    assert all((r["keep_id"], r["group_size"]) == keep[r["text_sha256"]] for r in got)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(make_docs(rows), fan_in=3)
    assert kept.columns == make_docs(rows).columns
    assert sorted(plain(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(make_docs([])).count() == exact_dedup.drop_exact_duplicates(make_docs([])).count() == 0


def test_bag_minhash_is_unbiased():
    rng = random.Random(5)
    for share in (0.02, 0.1):
        a = [rng.choice(WORDS) for _ in range(400)]
        b = [rng.choice(WORDS) if rng.random() < share else w for w in a]
        texts = [" ".join(a), " ".join(b)]
        sets = shingles.shingle_sets(texts, shingles.WordHashes(), 1)  # heavy counts
        sig = shingles.bag_minhash(*sets, 2, 4000)
        x, y = Counter(a), Counter(b)
        want = sum((x & y).values()) / sum((x | y).values())
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5 + 1e-9
        packed = shingles.pack(*sets, 2)
        assert shingles.similarity(*packed) == pytest.approx(want)
    one = shingles.shingle_sets(["a a a b b c", "b b b a a c c"], shingles.WordHashes(), 1)
    sig = shingles.bag_minhash(*one, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 5 / 8) < 0.04


def test_near_duplicates_against_all_pairs(make_docs):
    texts = list(ODD)
    for base in range(4):
        text = prose(base, 150)
        texts += [text, text, *(edited(text, s, 0.004 * (s % 9)) for s in range(25))]
    rows = list(enumerate(texts))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i] or "", texts[j] or "") >= 0.8]
    want = roots(len(texts), links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) and r["class_size"] == want.count(r["class_id"]) for r in got.values())
    docs = make_docs([*rows, (None, "one"), (3, "one")])
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").select("doc_id").distinct().collect()) == sorted(set(want))
    assert kept.where("doc_id IS NULL").count() == 1
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_crowded_buckets_lose_no_link(make_docs, monkeypatch):
    from airlake.llm import near

    monkeypatch.setattr(near, "BLOCK", 4)
    text = prose(77, 200)
    texts = [edited(text, s, 0.012) for s in range(80)]
    links = [(i, j) for i in range(80) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(make_docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(80)] == roots(80, links)


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    edges = spark.createDataFrame([*links, (None, 4), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark)).collect()}
    want = roots(400, links)
    assert got == {i: want[i] for link in links for i in link if link[0] != link[1]}
    assert connected_components(edges.limit(0), Scratch(spark)).count() == 0


def test_repeated_passages(make_docs):
    passage, line = prose(100, 60), prose(101, 40)
    texts = [
        prose(1, 90) + "\n" + line + "\n" + prose(2, 30),
        prose(3, 70) + " " + passage + " " + prose(4, 80),
        prose(5, 33) + " " + passage.replace(" ", "\n", 1) + " " + prose(6, 50),
        line + "\n" + prose(7, 60),
        edited(line, 1, 0.03) + "\n" + prose(8, 60),
        prose(9, 200),
        "short line\n" + prose(10, 80),
        "short line\n" + prose(11, 80),
    ]
    rows = list(enumerate(texts)) + [(90 + i, t) for i, t in enumerate(ODD)] + [(None, passage)]
    spans = substring_dedup.repeated_passages(make_docs(rows)).collect()
    assert {r["doc_id"] for r in spans if r["kind"] == "passage"} >= {1, 2}
    gone = {r["doc_id"] for r in spans if r["removed"]}
    assert {2, 3} <= gone and not gone & {0, 1, 5, 6, 7}
    assert not {r["doc_id"] for r in spans} & {5, 6, 7}
    if jaccard(line, edited(line, 1, 0.03)) >= 0.8:
        assert 4 in gone
    docs = make_docs(rows)
    cut = substring_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(after[i] == texts[i] for i in (0, 1, 5, 6, 7))
    assert line not in after[3] and after[3].strip() == prose(7, 60)
    assert prose(5, 33) in after[2] and prose(6, 50) in after[2] and len(after[2].split()) < 33 + 50 + 60
    assert after[None] == passage
    clash = docs.selectExpr("*", "1 AS _spans", "2 AS _text", "3 AS _id", "4 AS row")
    again = substring_dedup.drop_repeats(clash)
    assert again.columns == clash.columns and {r["doc_id"]: r["text"] for r in again.collect()} == after
    assert substring_dedup.repeated_passages(make_docs([])).count() == 0


def brute_vectors(vectors, least=0.9):
    import numpy as np

    n, links = len(vectors), []
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v) != 0) for v in vectors]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    links.append((i, j))
    counts = Counter(x for link in links for x in link)
    return [counts[i] for i in range(n)], roots(n, links)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_links(spark, monkeypatch, kind):
    import numpy as np

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    vectors = [(centres[i % 6] + rng.normal(size=12) * 0.25 * (i % 5)).astype("f4").tolist() for i in range(180)]
    vectors += [vectors[0]] * 30 + [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS key", "2 AS cell", "3 AS label")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(frame, per_cell=20).collect()}
    counts, want = brute_vectors(vectors)
    assert [got[i]["n_links"] for i in range(len(vectors))] == counts
    assert [got[i]["component_id"] for i in range(len(vectors))] == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.embedding_links(frame.limit(0)).count() == 0


STRANGE = [
    "It's   a TEST's\tof\x1codd\x85 spaces  and\n\n\nlines …", "naïve café Ångström ΑΒΓ ŒUVRE ǆ ﬁ", "x" * 5000, "ab" * 3000 + " !!!???" * 50,
    "1234567890 12,345.67", "😀😀 👩‍👩‍👧 🇩🇪", "  lead and trail  ", "<|endoftext|> <|startoftext|>", "'s 't 're I'M we'LL", "́a é", "​­﻿", "مرحبا 漢字かな 한국어",
]


def test_huge_and_tiny_vectors_link(spark):
    rows = [(1, [3e200, 4e200]), (2, [3e-200, 4e-200]), (3, [0.3, 0.4]), (4, [-3e300, 1e300]), (5, [5e-324, 0.0]), (6, [7.0, 0.0]), (3, [3.0, 4.0]), (None, [0.3, 0.4])]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), None: (0, None)}
    assert len(got) == len(rows) and all((r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got)


def test_chunks_have_the_ids_of_whole_texts():
    parts = list("abcXYZHJI  .,;:!?)\"'(-=<>|_~&%@[{`0\n\u00fc\u00f1\u00c9\u00df\u0444\u0451") + ["\u0338", "\u0331", "\u0327", "\u030c", "\u0307", "\u03a3", "\u0130", "\u212a", "\u3000", "\x1c", "'S", "'Re", "<|endoftext|>"]
    cache, rng = packing.ChunkIds(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        want = cache.tokenizer.encode(text, add_special_tokens=False).ids
        assert cache.of(text) == struct.pack(f"<{len(want)}I", *want), text


def test_own_tokens_in_any_letters():
    """A token's own text counts as it is written only: other cases of its letters are ordinary text."""
    cache, rng = packing.ChunkIds(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    own = [t.content for t in cache.tokenizer.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in own
    cased = lambda t: "".join(c.upper() if rng.random() < 0.5 else c for c in t)
    forms = [f(t) for t in own for f in (str, str.upper, str.title, str.swapcase)] + [cased(t) for t in own for _ in range(40)]
    for form in forms:
        for text in (form, f"a {form} b", f"Word{form}Word", f"é\u0301{form} {form.lower()}", f"{form[:5]} {form}{form}"):
            want = cache.tokenizer.encode(text, add_special_tokens=False).ids
            assert cache.of(text) == struct.pack(f"<{len(want)}I", *want), text


def test_packing(make_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, *STRANGE, prose(1, 5000), "x <|endoftext|> y", "x <|EndOfText|> <|STARTOFTEXT|> y"]
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "one")]
    got = packing.pack_documents(make_docs(rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        if i in (3, None):
            parts = parts[: len(parts)]
        ids = [x for p in parts for x in struct.unpack(f"<{p['length']}I", p["ids"])]
        if i not in (3, None):
            assert ids == want and all(p["doc_tokens"] == len(want) for p in parts)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got)
    crc = packing.with_ids_crc(packing.pack_documents(make_docs(rows[:5]), public_tokenizers.path("word_bpe_49k.json"))).collect()
    one = next(r for r in got if r["doc_id"] == 4)
    assert zlib.crc32(one["ids"]) in {r["ids_crc32"] for r in crc if r["doc_id"] == 4}
    assert packing.pack_documents(make_docs([]), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_bpe_matches_tiktoken(make_docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x24F), rng.randrange(0x4E00, 0x4F00), 0x1F600])) for _ in range(200)) for _ in range(20)]
    texts = [*ODD, *STRANGE, *noise, prose(1, 3000), " " * 3000, "\n \n" * 500]
    got = {r["doc_id"]: r for r in bpe.decode_documents(bpe.encode_documents(make_docs(list(enumerate(texts))), path, public_tokenizers.PATTERN), path).collect()}
    for i, text in enumerate(texts):
        want = coder.encode_ordinary(text or "")
        assert list(struct.unpack(f"<{len(want)}I", got[i]["ids"])) == want
        assert bytes(got[i]["decoded"]) == (text or "").encode()
    assert bpe.encode_documents(make_docs([]), path, public_tokenizers.PATTERN).count() == 0


def test_fold():
    assert toxicity.fold("An ІDІ0T, y0u 1d10t!!") == " an idiot you idiot "
    assert toxicity.fold("costs 100 $ in 2020") == " costs in "
    assert toxicity.fold("a55 a$$ ｉｄｉｏｔ ïdíöt id\u200bi\u00adot wow!! ﬁne") == " ass ass idiot idiot idiot wow fine "
    assert toxicity.fold("İDİOT 2nd v9 x10") == " idiot nd v xio "
    assert toxicity.fold("ıdıot ɪᴅɪᴏᴛ Іdіօt ᴍᴀɴ ԝӏ") == " idiot idiot idiot man wl "


def test_evidence_matches_brute_force():
    rng = random.Random(5)
    lexicon = toxicity.Lexicon({"bad": 1.0, "worse": 2.5, "ba": 0.5}, ("bad luck", "no worse", "so bad luck it"))
    for n in (0, 1, 5, 400):
        words = [rng.choice(["bad", "luck", "worse", "no", "so", "it", "badly", "ok"]) for _ in range(n)]
        text, total = f" {' '.join(words)} ", 0.0
        spans = [(m.start(), m.end()) for p in lexicon.exceptions for m in re.finditer(f"(?= {p} )", text) for m in [re.compile(f" {p} ").match(text, m.start())]]
        for stem, weight in lexicon.weights.items():
            for m in re.finditer(f" {stem}", text):
                if not any(a <= m.start() and m.end() <= b for a, b in spans):
                    total += weight
        blanks = toxicity.fold(text).count(" ")
        assert toxicity.evidence(text, toxicity.automaton(lexicon)) == pytest.approx(total / math.log2(2 + blanks))


def test_toxicity(spark, make_docs):
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = prose(i, 60) + (f" you idiot{'ic' * (i % 3)} " if bad else "") + (" idiot proof manual " if i % 40 == 1 else "") + prose(i + 999, 40)
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000, "an 1d1ot here " + prose(1, 10)), (1001, "an іdіоt " + prose(2, 10)), (1002, "IDIOT PROOF " + prose(3, 9)), (1003, None), (1004, ""), (None, "x"), (0, rows[0][1])]
    docs = make_docs(rows)
    known = spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, lexicon).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels)
    assert got[1000] >= 0.5 and got[1001] >= 0.5 and got[1002] < 0.5 and got[1003] == got[1004] < 0.5
    assert all(0 <= s <= 1 for s in got.values())
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(got[i] < 0.5 for i, _ in rows)
    none = toxicity.learn_lexicon(docs, known.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(make_docs([]), lexicon).count() == 0


def test_quality(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, prose(i, 80) if good else "### " * 50 + prose(i, 20), f"host{i % 7}", "p"))
        labels.append((i, int(good)))
    rows += [(1000, None, None, None), (1001, "", "new", "q"), (None, prose(1, 50), "host1", None), (0, rows[0][1], "host0", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS n", "2 AS k", "3 AS score")
    known = spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, known).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    tested = [(by[i]["predicted"], y) for i, y in labels if by[i]["held_out"]]
    assert len(tested) > 40 and sum(p == y for p, y in tested) / len(tested) > 0.97
    assert by[1000]["host_posterior"] == by[1001]["path_posterior"]
    assert quality.quality_scores(docs.limit(0), known).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, known.limit(0)).collect()} == {0.5}


def test_sparse_sites_shrink(spark):
    rows = [(i, "same text here", "big", "p") for i in range(200)] + [(500 + i, "same text here", "tiny", "p") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = docs.selectExpr("doc_id", "cast(source = 'tiny' OR doc_id % 2 = 0 as int) AS quality")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, known).collect()}
    assert 0.5 < got[500]["host_posterior"] < 0.99 and abs(got[1]["host_posterior"] - 0.5) < 0.06


def test_warc(spark, tmp_path):
    page = "<html lang='en'><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- <p>no</p> --><h1>Head</h1><p>One <b>bold</b><br>two &lt; 3</p><a href='/x'>go</a></body></html>"
    rows = [(1, "http://a/", page), (2, "http://a/", None), (3, None, ""), (None, "http://b/", "plain"), (1, "http://a/", page), (5, "http://c/", "<p>" * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS block", "'x' AS record_type")
    assert warc.plain_text(page) == "A & B\nHead\nOne bold\ntwo < 3\ngo"
    responses = warc.responses_of_pages(pages)
    got = warc.derive_records(responses).collect()
    assert len(got) == 2 * len(rows)
    source = {r["record_id"]: r for r in responses.collect()}
    for r in got:
        s = source[r["refers_to"]]
        body = s["payload"].encode()
        assert r["refers_to_target_uri"] == r["target_uri"] == s["target_uri"] and r["source_headers"] == s["http_headers"]
        assert r["source_payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["source_block_digest"] == warc.digest(s["http_headers"].encode() + b"\r\n\r\n" + body)
        assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        if r["record_type"] == "conversion":
            assert r["block"] == warc.plain_text(s["payload"])
    assert len({r["record_id"] for r in got}) == 2 * (len(rows) - 1)
    records = warc.derive_records(responses)
    warc.write_warc(records, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    kept = {(r["record_id"]): r for r in got}
    for r in back:
        made = kept[r["headers"]["WARC-Record-ID"]]
        assert r["headers"]["WARC-Source-Block-Digest"] == made["source_block_digest"] and r["headers"]["WARC-Source-Payload-Digest"] == made["source_payload_digest"]
        if made["record_type"] == "metadata":
            lines = [x[15:] for x in bytes(r["block"]).decode().split("\r\n") if x.startswith("source-header: ")]
            assert lines == made["source_headers"].split("\r\n")[1:]
    assert Counter((r["headers"]["WARC-Record-ID"], r["headers"]["WARC-Refers-To"], bytes(r["block"]).decode()) for r in back) == Counter((r["record_id"], r["refers_to"], r["block"]) for r in got)
    assert warc.derive_records(responses.limit(0)).count() == 0


def test_broken_pages_are_read_in_one_scan():
    """Unclosed tags, titles and references of 5 MB: the time grows with the page, not with its square."""
    leads = ["<title>", "<title ", "<a ", "<a href ", "<html ", "<html lang ", "<script ", "<script>", "</script ", "<!--", "<", "</title", "<p ", "&#9", "<style></style"]
    for lead in leads:
        for end in ("", ">"):
            began = time.process_time()
            warc.read_page(lead * (5_000_000 // len(lead)) + end)
            assert time.process_time() - began < 8, lead  # seconds; a square would take hours
    assert warc.plain_text("&#" + "9" * 100_000 + "; &#00000000065; &#x41;") == "\ufffd \ufffd A"
    assert warc.read_page("<html xml:lang=de lang='en'><title>a<title>b</title>") == ("a\nb", "a b", "en", 0)
    assert warc.read_page("<!-- <a href=x> --><script><a href=y></script><a id=1 href=z>1</a> <a name=q>2</a> 3 < 4 <5 <") == ("1 2 3 < 4 <5 <", "", "", 1)


def test_page_text_equals_the_parser_of_the_library():
    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.links, self.depth, self.titles, self.lang = [], 0, 0, [], ""

        def handle_starttag(self, tag, attrs):
            names = dict(attrs)
            self.links += tag == "a" and "href" in names
            self.lang = self.lang or (tag == "html" and names.get("lang")) or ""
            self.depth += tag in ("script", "style")
            if tag in BLOCKS:
                self.out.append("\n")
            if tag == "script":  # what is left out parts words
                self.out.append(" ")
            if tag == "title":
                self.titles.append("")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.depth -= tag in ("script", "style")
            if tag in BLOCKS:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.depth:
                self.out.append(data)
                if self.titles and self.lasttag == "title":
                    self.titles[-1] += data

    BLOCKS = ("p", "div", "h1", "li", "ul", "title", "head", "body", "br")
    rng = random.Random(8)

    def tree(depth):
        kind = rng.randrange(9)
        if depth == 0 or kind < 3:
            return rng.choice(["rain &amp; snow", "a &lt; b", "wind\n  leaf", "é 漢字", "x&#65;y", "&nbsp;", " "])
        inside = "".join(tree(depth - 1) for _ in range(rng.randint(0, 4)))
        if kind == 3:
            return f"<script type='x'>var a = '<p>';{rng.random()}</script>"
        if kind == 4:
            return f"<!-- <p>{rng.random()}</p> -->"
        if kind == 5:
            return rng.choice([f'<a href="/x">{inside}</a>', f"<A NAME=q>{inside}</A>", "<br>", "<br/>"])
        tag = rng.choice(["p", "div", "span", "b", "li", "ul", "h1", "P", "Div"])
        return f"<{tag} class='c'>{inside}</{tag}>"

    for _ in range(300):
        page = f"<!DOCTYPE html><html lang='en'><head><title>T {rng.random()}</title></head><body>{''.join(tree(5) for _ in range(6))}</body></html>"
        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in "".join(reader.out).split("\n"))
        got = warc.read_page(page)
        assert got.text == "\n".join(line for line in lines if line) and got.links == reader.links and got.language == reader.lang and got.title == reader.titles[0]


def test_license_scan(spark):
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.txt", prose(1, 30)),
        (3, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0.\n\n"),
        (4, "a/b/c/d/y.txt", prose(2, 30)),
        (5, "a/bb/z.txt", "This work is licensed under the GNU General Public License, version 3.\n" + prose(3, 40)),
        (6, "q/w.txt", prose(4, 20)),
        (7, None, None),
        (8, "a/b/c/e", ""),
        (None, "a/n", prose(5, 9)),
        (9, "a/long", "the license of " * 20000),
        (8, "a/b/c/e", ""),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string").selectExpr("*", "1 AS line", "2 AS dir", "3 AS hits")
    got = {r["id"]: r for r in licenses.license_scan(files, templates).collect()}
    assert len(got) == len(rows) - 1
    assert [(got[i]["license"], got[i]["inherited_from"]) for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [
        ("MIT", None), ("MIT", "a"), ("Apache-2.0", None), ("Apache-2.0", "a/b/c"), ("GPL-3.0", None), (None, None), (None, None), ("Apache-2.0", "a/b/c"),
    ]
    assert got[None]["license"] == "MIT" and got[9]["own_license"] is None
    assert licenses.license_scan(files.limit(0), templates).count() == 0


def test_licence_files_and_headers(spark):
    """Whole licence files and headers, wrapped, in comments, with other names; what looks alike but is none."""
    text = dict(licenses.FILES)
    wrap = lambda t, sign="": "\n".join(sign + line for p in t.split("\n") for line in (textwrap.wrap(p, 70) or [""]))
    rows = [
        (1, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Ann Other\n\n" + wrap(text["MIT"])),
        (2, "m/src/a.py", prose(1, 80)),
        (3, "b3/LICENSE.txt", "Copyright 2019, The Owners\n\n" + wrap(text["BSD-3-Clause"])),
        (4, "b2/COPYING", wrap(text["BSD-2-Clause"])),
        (5, "x/y.c", wrap(licenses.HEADERS[0][1], "# ") + "\n#\n\n" + prose(2, 200).replace(" ", "\n")),
        (6, "x/z.c", prose(3, 200)),
        (7, "g/main.c", "/*\n" + wrap(licenses.HEADERS[2][1], " * ") + "\n */\n\n" + prose(4, 100)),
        (8, "w/essay.txt", "We read the license of the software and the copyright notice, " + prose(5, 60)),
        (9, "w/blank", "\n" * 30_000),
        (10, "i/LICENSE", wrap(text["ISC"])),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    got = {r["id"]: (r["license"], r["inherited_from"]) for r in licenses.license_scan(files, templates).collect()}
    assert got == {
        1: ("MIT", None), 2: ("MIT", "m"), 3: ("BSD-3-Clause", None), 4: ("BSD-2-Clause", None), 5: ("Apache-2.0", None), 6: (None, None),
        7: ("GPL-3.0", None), 8: (None, None), 9: (None, None), 10: ("ISC", None),
    }


def plain_license_scores(texts, templates, least):
    """The best (score, licence) of each text over all lines, paragraphs and the whole, and of the whole alone: every pair, dense counts."""
    import math

    import regex

    terms = lambda t: Counter(regex.findall(licenses.TERM, t.lower()))
    lines = [c for t in texts for c in map(terms, (t or "").split("\n")) if c]
    known = {w for _, t in templates for w in terms(t)}
    idf = {w: math.log((1 + len(lines)) / (1 + sum(w in c for c in lines))) + 1 for w in known}
    weigh = lambda c: {w: n * idf.get(w, math.log(1 + len(lines)) + 1) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, v, norm(v)) for name, v in ((name, weigh(terms(t))) for name, t in templates)]
    out = []
    for t in texts:
        parts = [t or ""]
        if "\n" in parts[0]:
            parts += [p for p in regex.split(r"\n[^\p{L}\p{N}]*\n", t) if "\n" in p] + t.split("\n")
        found = []
        for part in parts:
            c = weigh(terms(part))
            hits = [(-round(sum(x * v.get(w, 0) for w, x in c.items()) / (norm(c) * n), 9), name) for name, v, n in vectors] if c else []
            found.append(min((h for h in hits if -h[0] >= least), default=None))
        out.append((min(filter(None, found), default=None), found[0]))
    return out


def test_license_scan_against_all_pairs(spark):
    """Counts of terms weigh: texts mixed of template terms and others, with many repeats, at two thresholds."""
    rng = random.Random(5)
    base = [t for n, t in licenses.TEMPLATES if len(t) < 3000]
    texts = [None, "", "license " * 400, "the the the license\n\nMIT MIT license"]
    for k in range(150):
        words = rng.choice(base).split()
        words = [w if rng.random() < rng.choice([0.7, 0.9, 1]) else rng.choice(["the", "software", *WORDS]) for w in words]
        words += [rng.choice(words)] * rng.choice([0, 0, 3, 12])
        texts.append(" ".join(w + ("\n" if rng.random() < 0.1 else "") for w in words) + rng.choice(["", "\n\n" + prose(k, 50), "\n//\n \n" + rng.choice(base) + "\n--"]))
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    for least in (0.8, 0.55):
        want = plain_license_scores(texts, licenses.TEMPLATES, least)
        got = {r["id"]: (r["own_license"], r["own_score"]) for r in licenses.license_scan(files, templates, least).collect()}
        for i, (best, _) in enumerate(want):
            assert (got[i][0], got[i][1] and round(got[i][1], 7)) == ((best[1], round(-best[0], 7)) if best else (None, None)), (i, texts[i])
        assert 30 < sum(b is not None for b, _ in want) < len(texts)


def test_long_licence_texts_pass_to_their_directories(spark):
    """Published texts, wrapped anew, with a project's name in front; a directory below has another one."""
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    whole = {n: max((t for m, t in licenses.FILES if m == n), key=len) for n in names}
    rows, want = [], {}
    for k, name in enumerate(names):
        text = "\n".join(line for p in whole[name].split("\n\n") for line in [*textwrap.wrap(p, 60 + k), ""])
        rows += [(3 * k, f"{name}/COPYING", f"Project {k}\n\n{text}"), (3 * k + 1, f"{name}/src/deep/a.c", prose(k, 60))]
        rows.append((3 * k + 2, f"{name}x/a.c", prose(100 + k, 60)))
        want |= {3 * k: (name, None), 3 * k + 1: (name, name), 3 * k + 2: (None, None)}
    rows += [(90, "GPL-3.0/src/deep/LICENSE", whole["Unlicense"])]
    want |= {90: ("Unlicense", None), 3 * names.index("GPL-3.0") + 1: ("Unlicense", "GPL-3.0/src/deep")}
    files = spark.createDataFrame(rows, "id long, path string, text string")
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    assert {r["id"]: (r["license"], r["inherited_from"]) for r in licenses.license_scan(files, templates).collect()} == want


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    base, passage = [prose(1000 + k, 60 + 9 * k) for k in range(12)], prose(77, 70)
    texts = [*base, base[2].replace(" ", "  "), edited(base[5], 1, 0.02), edited(base[7], 2, 0.02), "", None, " \n"]
    texts += [prose(1100, 40) + " qa " + passage + " qb " + prose(1101, 30), prose(1102, 25) + " qc " + passage + " qd " + prose(1103, 35)]
    texts += ["grubix snarfo " + prose(1200 + k, 50) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars", "1 AS root")
    known = [(i, 1, int("snarfo" in (t or ""))) for i, t in enumerate(texts)]
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # Plain stages: the planted words go, then equal texts, near copies, and the passage of the later document.
    left = {i: t or "" for i, t in enumerate(texts) if "snarfo" not in (t or "")}
    groups = {}
    for i, t in left.items():
        groups.setdefault("".join(t.split()), []).append(i)
    left = {i: left[i] for i in sorted(max(g, key=lambda i: (len(texts[i] or ""), -i)) for g in groups.values())}
    ids = list(left)
    root = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if jaccard(left[ids[a]], left[ids[b]]) >= 0.8])
    left = {i: left[i] for k, i in enumerate(ids) if root[k] == k}
    left[19] = left[19].replace(passage + " ", "").strip()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(struct.unpack(f"<{r['length']}I", r["ids"]))
    assert got == want
    assert 12 not in got or 2 not in got


def test_bands():
    for rows in (3, 5):
        bands = tune_bands(0.8, rows, 1e-4)
        assert (1 - 0.8**rows) ** bands <= 1e-4 < (1 - 0.8**rows) ** (bands - 1)


def test_shared_runs_are_whole(make_docs):
    """Every word of a shared run of 24 words or more is reported and cut, wherever the run stands."""
    runs = [prose(500 + k, 24 + 7 * k) for k in range(14)]
    first = [prose(600 + k, 60) + " qa " + r + " qb " + prose(700 + k, 60) for k, r in enumerate(runs)]
    again = [prose(800 + k, 11 + k) + " qc " + r + " qd " + prose(900 + k, 70) for k, r in enumerate(runs)]
    docs = make_docs(list(enumerate(first + again)))
    spans = {(r["doc_id"], r["start_word"], r["end_word"], r["removed"]) for r in substring_dedup.repeated_passages(docs).collect()}
    for k, run in enumerate(runs):
        size = len(run.split())
        assert (k, 61, 61 + size, False) in spans and (14 + k, 12 + k, 12 + k + size, True) in spans
    cut = {r["doc_id"]: r["text"].split() for r in substring_dedup.drop_repeats(docs).collect()}
    for k in range(14):
        assert cut[k] == first[k].split() and cut[14 + k] == (prose(800 + k, 11 + k) + " qc qd " + prose(900 + k, 70)).split()


def test_runs_whose_blocks_stand_earlier_elsewhere(make_docs):
    """Every run of 24 words that an earlier text has is removed, also where a third text has a shorter part of it first, and nothing else is."""
    n, texts = 30, []
    runs = [prose(2000 + k, 30 + k % 9).split() for k in range(n)]
    texts += [prose(2100 + k, 40) + " qa " + " ".join(r[k % 8 : k % 8 + 22]) + " qb " + prose(2200 + k, 30) for k, r in enumerate(runs)]
    texts += [prose(2300 + k, 35) + " qc " + " ".join(r) + " qd " + prose(2400 + k, 30) for k, r in enumerate(runs)]
    texts += [prose(2700 + k, 20) + " qi " + " ".join(r[3 : 3 + 20 + k % 9]) + " qj " + prose(2800 + k, 30) for k, r in enumerate(runs)]
    texts += [prose(2500 + k, 25) + " qe " + " ".join(r) + " qf " + prose(2600 + k, 30) for k, r in enumerate(runs)]
    seen, asked = set(), {}
    for i, text in enumerate(texts):
        words, grams = text.split(), []
        for p in range(len(words) - 23):
            grams.append(tuple(words[p : p + 24]))
            if grams[-1] in seen:
                asked.setdefault(i, set()).update(range(p, p + 24))
        seen.update(grams)
    found = {}
    for r in substring_dedup.repeated_passages(make_docs(list(enumerate(texts)))).collect():
        assert r["end_word"] - r["start_word"] >= 24 and r["keep_id"] is not None
        if r["removed"]:
            found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert len(asked) > n and found == asked


def test_short_lines_near_copies_and_own_repeats(make_docs):
    line, passage, own = prose(40, 9), prose(41, 60).split(), prose(42, 50)
    changed = [*passage[:42], "qz", *passage[43:]]
    texts = [
        line + "\n" + prose(43, 70),
        line + "\n" + prose(44, 70),
        prose(45, 33) + " qa " + " ".join(passage) + " qb " + prose(46, 44),
        prose(47, 12) + " qc " + " ".join(changed) + " qd " + prose(48, 51),
        own + " qe " + prose(49, 30) + " qf " + own + " qg",
    ]
    docs = make_docs(list(enumerate(texts)))
    spans = {(r["doc_id"], r["start_word"], r["end_word"], r["kind"], r["keep_id"], r["removed"]) for r in substring_dedup.repeated_passages(docs).collect()}
    assert spans == {
        (0, 0, 9, "paragraph", 0, False), (1, 0, 9, "paragraph", 0, False),
        (2, 34, 94, "passage", 2, False), (3, 13, 73, "passage", 2, True),
        (4, 0, 50, "passage", 4, False), (4, 82, 132, "passage", 4, True),
    }
    cut = {r["doc_id"]: r["text"].split() for r in substring_dedup.drop_repeats(docs).collect()}
    assert cut[1] == texts[1].split() and cut[3] == (prose(47, 12) + " qc qd " + prose(48, 51)).split()
    assert cut[4] == (own + " qe " + prose(49, 30) + " qf qg").split()


def test_tables_that_nothing_reads_are_gone(make_docs, monkeypatch):
    """While chains are compared, the sketches of texts and the nodes of lines are deleted; hits that batches of a few rows deal out are the same chains."""
    passage, line, kept, live = prose(61, 400), prose(62, 12), [], []
    texts = [prose(63 + k, 40 + k) + " " + passage + " qa " + prose(73 + k, 30) + "\n" + line for k in range(4)]
    keep, grown = Scratch.keep, substring_dedup._grown

    def watched(docs, chains, threshold, width, scratch):
        live.extend(t.columns for t in kept if t._scratch_path in scratch.paths)
        return grown(docs, chains, threshold, width, scratch)

    docs = make_docs(list(enumerate(texts)))
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(table := keep(self, df)) or table)
    monkeypatch.setattr(substring_dedup, "_grown", watched)
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "7")
    try:
        spans = {(r["doc_id"], r["start_word"], r["end_word"], r["kind"], r["keep_id"], r["removed"]) for r in substring_dedup.repeated_passages(docs).collect()}
    finally:
        conf.set(name, before)
    assert live and not any({"paragraphs", "blocks", "sig"} & set(columns) for columns in live)
    # The passage grows over the 31 edited words to the equal line.
    assert {x for x in spans if x[3] == "passage"} == {(k, 40 + k, 483 + k, "passage", 0, k > 0) for k in range(4)} | {(0, 40, 483, "passage", 0, False)}
    assert {x for x in spans if x[3] == "paragraph" and x[2] - x[1] == 12} == {(k, 471 + k, 483 + k, "paragraph", 0, False) for k in range(4)}


def test_words_have_the_places_of_the_cut():
    """Spans count the words of lowered bytes, cuts those of the text as it is: letters that grow or change by what stands beside them must not part them."""
    rng = random.Random(7)
    parts = [*"ΣσςİıIi̇ΑαßẞſKÅ éE’'.,- \n_0٣漢", "\u0307", "\u0301", "\u00ad", "\u200d", "ΑΣ", "İs", "Σ’Α", "Σ'Α", "ﬁ", "ǅ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(20000)] + ["Σ İstanbul one", "ΟΔΟΣ. İ"]
    hashes, starts, _ = substring_dedup._words(texts)
    named = {}
    for i, text in enumerate(texts):
        words = [w.lower() for w in shingles.WORD.findall(text)]
        assert starts[i + 1] - starts[i] == len(words), text
        for word, value in zip(words, hashes[starts[i] : starts[i + 1]].tolist()):
            assert named.setdefault(word, value) == value, text
    assert len(set(named.values())) == len(named)


def test_word_hashes_name_the_lower_case_words(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_AT_ONCE", 50)
    texts = ["", "\n", "A b_c\n\nÉa é “d”—e…f", "x" * 200 + " y " + "X" * 200, "\r\tz\x0bw\x00v", "ΑΣ ας Σ’Α ΑΣ’Α", "日本 語\nテ ٣", "²x ß ẞ K k İi", "a\n"]
    hashes, starts, line = substring_dedup._words(texts)
    words, lines = [], []
    for i, text in enumerate(texts):
        assert starts[i] == len(words)
        for n, part in enumerate(text.split("\n")):
            found = [w.lower() for w in shingles.WORD.findall(part)]
            words += found
            lines += [(i, n)] * len(found)
    assert starts[-1] == len(words) == len(hashes)
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    assert [a != b for a, b in zip(line[1:], line)] == [a != b for a, b in zip(lines[1:], lines)]
    assert len(substring_dedup._words([])[0]) == 0
