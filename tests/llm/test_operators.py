"""Each operator against a brute-force version on small fixtures, and on awkward tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import common, decontaminate, licenses, line_dedup, mtree, packing, quality, quotes, simhash, toxicity, urls
from ledgerloom.llm.common import stored
from ledgerloom.llm.components import connected_components

rng = random.Random(5)
VOCAB = ["the", "of", "and", "Ümlaut", "river", "stone", "letter", "Moon", "seven", "Quick", "brown", "lamp", "table", "wind", "harbour", "çedilla"]


def prose(n, words=VOCAB):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def edited(text, k):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9999))
    return " ".join(words)


def documents(n=60):
    base = [prose(rng.randrange(30, 160)) for _ in range(n)]
    rows = list(enumerate(base))
    for k in range(12):
        rows.append((n + k, base[k]))
        rows.append((n + 50 + k, edited(base[k], 1)))
        rows.append((n + 100 + k, base[k] + "\nA shared line about the harbour lamp, number one of the set.\n\n" + base[k + 1]))
    return rows


AWKWARD = [(None, "no id at all here"), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, prose(30_000)), (6, "É\u2028ö 漢字 e\u0301 \x00 \x1f x"), (7, "same line of text, long enough\nsame line of text, long enough")]
CLASHING = ["fp", "row", "component", "lid", "length", "label", "_contamination", "key", "score", "node"]


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame(documents(), "doc_id long, text string"))


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return stored(df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING]))


@pytest.fixture(scope="module")
def empty(spark):
    return stored(spark.createDataFrame([], "doc_id long, text string, fp int"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(0, 60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, docs):
    texts = dict(documents_of(docs))
    piece = " ".join(texts[5].split(" ")[4:22])
    rows = [(1, "The " + piece.upper() + " tail ends"), (2, "Stone7, harbour"), (3, None), (4, "..."), (None, "null item"), (5, " ".join(texts[9].split(" ")[:10])), (50, " ".join(texts[9].split(" ")[:10]))]
    return spark.createDataFrame(rows, "item_id long, text string")


def documents_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# components


def test_components(spark):
    links = [(k, k + 1) for k in range(100)] + [(200, 200 + k) for k in range(50)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    for local in (250_000, 0, 60):  # in one task, in rounds, in rounds finished in one task
        got = [tuple(r) for r in connected_components(spark.createDataFrame(links, "u long, v long"), local).collect()]
        assert dict(got) == {k: 0 for k in range(101)} | {200 + k: 200 for k in range(50)} | {300: 300, 301: 300} and len(got) == len(dict(got))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 quotation linking


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there, how is the weather in the north?\n\nSecond paragraph\nof two lines"),
        (1, 1, "assistant", "> hello there,  HOW is the weather in the north?\nCold."),
        (1, 2, "user", ">> Hello there, how is the weather in the north?\n> Cold.\nThanks"),
        (1, 3, "user", "> of two lines\nWhy two?"),
        (1, 4, "user", "> never said\nHm"),
        (1, 5, "user", None),
        (2, 0, "user", "> Cold.\nother conversation"),
        (None, 0, "user", "> Cold.\nlost"),
        (3, None, "user", ""),
        (1, 6, "user", "> > Cold.\n>Thanks\nok"),
        (1, 6, "user", "> > Cold.\n>Thanks\nok"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash"))
    got = sorted(((r["conv_id"], r["turn"], r["body"], r["parent"], r["root"], r["depth"], r["n_quotes"]) for r in quotes.reply_ordered(df).collect()), key=str)
    want = [
        (1, 0, rows[0][3], None, 0, 0, 0), (1, 1, "Cold.", 0, 0, 1, 1), (1, 2, "Thanks", 1, 0, 2, 2), (1, 3, "Why two?", 0, 0, 1, 1), (1, 4, "Hm", None, 4, 0, 1), (1, 5, None, None, 5, 0, 0),
        (2, 0, "other conversation", None, 0, 0, 1), (None, 0, "lost", None, 0, 0, 1), (3, None, "", None, None, 0, 0), (1, 6, "ok", 2, 0, 3, 2), (1, 6, "ok", 2, 0, 3, 2),
    ]
    assert got == sorted(want, key=str)
    order = [r["turn"] for r in quotes.reply_ordered(df).where("conv_id = 1").orderBy("position").collect()]
    assert order == [0, 1, 3, 2, 6, 6, 4, 5]
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, k, "user", f"> message {k - 1} says so\nmessage {k} says so" if k else "message 0 says so") for k in range(130)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["turn"], r["root"], r["depth"], r["position"]) for r in got} == {(k, 0, k, k) for k in range(130)}


def quoted_fixture(n_conversations=25):
    """Conversations whose replies quote whole messages, paragraphs, lines and quotes, nested, repeated and forked."""
    own, rows = random.Random(21), []
    for conv in range(n_conversations):
        said = []
        for turn in range(own.randrange(1, 14)):
            body = "\n\n".join("\n".join(f"{own.choice(VOCAB)} says {own.randrange(6)} of {own.choice(VOCAB)}" for _ in range(own.randrange(1, 3))) for _ in range(own.randrange(1, 3)))
            lines = []
            for _ in range(own.choice([0, 1, 1, 2]) if said else 0):
                whole = own.choice(said)
                part = own.choice([whole, own.choice(whole.split("\n\n")), own.choice(whole.split("\n")), "never said so"])
                part = own.choice([str, str.upper, lambda x: x.replace(" ", "   ")])(part)
                lines += [own.choice(["> ", ">", " >\t"]) + x for x in part.split("\n")]
                if own.random() < 0.4:
                    lines += [body.split("\n")[0]]
            text = "\n".join([*lines, body])
            said.append(text if own.random() < 0.5 else body)
            rows.append((conv, turn, own.choice(["user", "assistant"]), text))
    return [*rows, (100, 0, "user", None), (100, 1, "user", ""), (100, 2, "user", "> \n>\n x")]


def test_quotes_against_sql(spark, tmp_path):
    import duckdb

    from ledgerloom.llm import queries

    rows = quoted_fixture()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op1_quote_threads(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op1_quote_threads"])
    columns = [d[0] for d in want.description]
    found = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert found == Counter(want.fetchall())
    assert sum(r["n_linked"] > 0 for r in got.collect()) > 40 and got.where("depth > 1").count() > 5


def test_long_messages_and_repeats(spark):
    long = "\n".join(f"line {k} of a long message" for k in range(30_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "> line 29999 of a LONG message\nyes"), (1, 1, "user", "> line 29999 of a LONG message\nyes")]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["parent"], r["position"]) for r in got if r["turn"]) == [(1, 0, 1), (1, 0, 2)] and len(got) == 3


# 2 URL rules


def judge(url, rules):
    m = regex.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    rules = [*urls.RULES, ("org", "", "block"), ("a.org", "/x", "allow"), ("a.org", "/x/y", "block"), ("b.a.org", "/x/y/z", "allow")]
    hosts = ["Example.COM", "www.example.com", "notexample.com", "com", "x.net", "net", "a.org", "b.a.org", "c.b.a.org", "", "a..org", "example.com:80", "u@example.com"]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/es/1", "/fr/", "/x", "/x/y", "/x/y/z/w?q=1", "?/en/", "#/en/"]
    some = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://example.com/en/", "http://net/es/" * 2, "http://net/es/", "x\ny://net/fr/\nz"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(some)] + [(0, some[0]), (None, "http://net/fr/")], "page_id long, url string").withColumn("key", F.lit(1))
    got = urls.judged(df, urls.rules_table(spark, rules)).collect()
    assert len(got) == len(some) + 2
    for r in got:
        assert (r["_host"], r["_path"], r["_rule"], r["_verdict"]) == judge(r["url"], rules), r
    long = "http://" + "a." * 60 + "example.com/en/" + "x/" * 50_000  # a very long url
    assert [r["_verdict"] for r in urls.judged(spark.createDataFrame([(1, long)], "page_id long, url string"), urls.rules_table(spark)).collect()] == ["block"]
    assert urls.judged(df.limit(0), urls.rules_table(spark)).count() == 0
    assert {r["_verdict"] for r in urls.judged(df, urls.rules_table(spark, rules).limit(0)).collect()} == {"allow"}


# 3 SimHash


def plain_fingerprint(text):
    w = regex.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    part = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = defaultdict(lambda: math.inf)
    for (i, _), c in zip(rows, part, strict=True):
        low[c] = min(low[c], i if i is not None else math.inf)
    return Counter((i, f, low[c] if low[c] < math.inf else None) for (i, _), f, c in zip(rows, fps, part, strict=True))


def test_simhash(docs, awkward, empty):
    for df in (docs, awkward):
        got = simhash.simhash_components(df).collect()
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == plain_components(documents_of(df))
        assert sum(r["keeper"] for r in got) == len({r["component_id"] for r in got} - {None}) + len({r["fp"] for r in got if r["component_id"] is None})
    assert simhash.simhash_dedup(awkward).columns == awkward.columns
    assert simhash.simhash_components(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_fingerprint_links(spark):
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 7))) for b in base for _ in range(12)]
    fps = sorted({*base, *near, 0})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for block in (4, 2048):  # the smaller cuts postings into blocks
        links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block).collect()
        at = {f: k for k, f in enumerate(signed)}
        assert classes(len(fps), [(at[r["u"]], at[r["v"]]) for r in links]) == want


def test_tally_prunes_before_verification():
    """In an index of a group only pairs that share four positional bytes are verified, and no link is lost."""
    base = [rng.getrandbits(40) << 24 | 0xABCDEF for _ in range(300)]  # a group's key: three bytes alike
    fps = np.array(sorted({*base, *(b ^ 1 << rng.randrange(24, 64) ^ 1 << rng.randrange(24, 64) for b in base)}), np.uint64)
    index = simhash.Postings(fps)
    links = index.spanning()
    pairs = [(i, j) for i in range(len(fps)) for j in range(i)]
    shared = [p for p in pairs if sum(fps[p[0]].tobytes()[k] == fps[p[1]].tobytes()[k] for k in range(8)) >= 4]
    assert index.verified <= len(shared) + len(links) and index.verified < len(pairs) / 10
    assert classes(len(fps), links) == classes(len(fps), [p for p in pairs if (int(fps[p[0]]) ^ int(fps[p[1]])).bit_count() <= 4])


# 4 decontamination


def plain_contamination(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for i in range(max(1, len(v) - window + 1)) if v else ():
            win = v[i : i + window]
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [500_000, 8])
def test_contamination(docs, awkward, empty, benchmark, block):
    items = [(r[0], r[1]) for r in benchmark.collect() if r[0] is not None]
    for df in (docs, awkward):
        texts = documents_of(df)
        got = decontaminate.contamination_report(df, benchmark, block_words=block).collect()
        want = Counter((i, *plain_contamination(t, items)) for i, t in texts)
        assert Counter(tuple(r)[:6] for r in got) == want
    kept = decontaminate.decontaminated(awkward, benchmark, block_words=block)
    assert kept.columns == awkward.columns and kept.count() == sum(n for k, n in want.items() if not k[5])
    assert decontaminate.contamination_report(empty, benchmark).count() == 0
    assert decontaminate.contamination_report(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_longest_match(docs, benchmark):
    r = decontaminate.contamination(docs.where("doc_id = 5"), benchmark).first()["_contamination"]
    assert (r["longest"], r["longest_at"]) == (18, [4, 1]) and r["spans"][:2] == [4, 22]


def test_longest_match_from_every_owner():
    """The longest match with any item, by trying every pair of places."""
    ten, more = [b"a%d" % k for k in range(10)], [b"b%d" % k for k in range(10)]
    for items in ([("a", ten), ("b", ten + more)], [("b", ten + more), ("a", ten)]):
        test = decontaminate.TestSide(items)
        found = decontaminate._hits([b" ".join([b"x", b"y", *ten, *more])], test)[0]
        assert found[3:] == (20, [2, 0])
    own = random.Random(9)
    for _ in range(60):
        word = lambda: own.choice([b"a", b"b"])
        items = [(str(k), [word() for _ in range(own.randrange(1, 9))]) for k in range(4)]
        text = [word() for _ in range(30)]
        got = decontaminate._hits([b" ".join(text)], decontaminate.TestSide(items, 3))[0]
        best = 0
        for _, item in items:
            for i in range(len(item)):
                for j in range(len(text)):
                    n = 0
                    while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
                        n += 1
                    best = max(best, n if n >= 3 or n == len(item) else 0)
        assert got[3] == best
        if best:
            at, where = got[4]
            assert any(text[at : at + best] == item[where : where + best] for _, item in items)


# 5 packing


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, awkward, empty, capacity):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    for df in (docs, awkward):
        got = packing.packed(df, capacity=capacity, keep_ids=True).collect()
        want = Counter()
        for i, t in documents_of(df):
            ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                want[i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
            assert len(r["ids"]) == r["length"]
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
    assert packing.packed(empty).count() == 0


def test_encoder_is_the_tokenizer():
    """Ids of an untouched tokenizer, special tokens and very long texts included."""
    from tokenizers import Tokenizer

    encoder, model = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    assert encoder.fast is not None
    texts = ["foo  bar", "foo\n bar ", " \n\n a", "don't 's  'll", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|", " ", "漢字 e\u0301 ö\u2028", "1 22 333  4444", prose(500), ""]
    texts += [x * (n // len(x)) + tail for n in (199_998, 200_004, 400_000) for x in ("a", " ", "\n ", "1234567890", "漢字", "!?", "<|endoftext|>") for tail in ("", "x <|endoftext|>")]
    for t in texts:
        assert np.array_equal(np.frombuffer(encoder.encode(t), "<u4"), model.encode(t, add_special_tokens=False).ids), t[:40]
    assert np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def best_bins(sizes, capacity):
    """Exact, by trying every bin for every piece."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal():
    cases = [[10, 28, 39, 10, 33, 12, 44, 34, 38, 23, 29], [40, 44, 14, 43, 28, 28, 11, 23, 14, 36, 18]]
    cases += [[rng.randrange(2 if k % 2 else 10, rng.choice([45, 60, 70, 99])) for _ in range(rng.randrange(8, 14))] for k in range(200)]
    for sizes in cases:
        least = best_bins(sizes, 100)
        for nodes in (None, packing.NODES):
            found = packing.BinCompletion(dict(Counter(sizes)), 100, nodes)
            solved = found.solve()
            assert found.bound <= found.bins == sum(n for _, n in solved) == least, sizes
            assert sum((Counter({x: n * f.count(x) for x in set(f)}) for f, n in solved), Counter()) == Counter(sizes)
    assert packing.BinCompletion({}, 100).solve() == []


def test_fillings_are_all_listed():
    """Every set of pieces that fits, least waste first; the undominated ones by trying every swap."""
    for _ in range(40):
        sizes = [rng.randrange(3, 30) for _ in range(7)]
        counts = np.bincount(sizes, minlength=51)
        got = list(packing.BinCompletion.fillings(counts, 50))
        sets = {tuple(sorted((sizes[i] for i in range(7) if m >> i & 1), reverse=True)) for m in range(128)}
        assert sorted(f for _, f, _ in got) == sorted(s for s in sets if sum(s) <= 50)
        assert [w for w, _, _ in got] == sorted(50 - sum(f) for _, f, _ in got)
        for waste, f, good in got:
            parts = {tuple(f[i] for i in range(len(f)) if m >> i & 1) for m in range(1 << len(f))}
            swaps = [(x, p) for x in set(sizes) if counts[x] > f.count(x) for p in parts if sum(p) <= x <= sum(p) + waste and (x > sum(p) or len(p) > 1)]
            assert good == (not swaps)


# 6 toxicity, 9 quality


def labelled(spark, kind):
    rows = []
    for k in range(500):
        bad = k % 4 == 0
        text = prose(40)
        if bad and kind == "toxic":
            text += " you awful" + rng.choice(["scoundrel", "scoundrels"]) + " " + prose(10)
        if bad and kind == "quality":
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        rows.append((k, text, int(bad) if kind == "toxic" else int(not bad)))
    df = stored(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    return df.drop("label"), df.select("doc_id", F.col("label").alias(kind))


def check_scores(got, truth, cut):
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_toxicity(spark, awkward, empty, labels):
    df, known = labelled(spark, "toxic")
    check_scores(toxicity.toxicity_scores(df, known).collect(), dict(known.collect()), 0.5)
    got = toxicity.toxicity_scores(awkward, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in AWKWARD)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.toxicity_scores(awkward, labels.limit(0)).count() == len(AWKWARD)


def test_toxicity_counts_all_but_the_calibration(spark, monkeypatch):
    df, known = labelled(spark, "toxic")
    learnt, count = [], toxicity.word_counts
    monkeypatch.setattr(toxicity, "word_counts", lambda docs: learnt.append(Counter(r["text"] for r in docs.collect())) or count(docs))
    toxicity.toxicity_scores(df, known, calibration=20)
    folds = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in documents_of(df)}
    texts = dict(documents_of(df))
    assert sum(learnt[0].values()) == sum(f != 0 for f in folds.values()) - 20
    assert learnt[0] >= Counter(texts[i] for i, f in folds.items() if f > 1) and not learnt[0] & Counter(texts[i] for i, f in folds.items() if f == 0)


def written_out_model(rows, discount=0.75, order=6):
    """(ratio of a byte after a context, n-grams): recursive Kneser-Ney by the formulas, on the distinct (word before, word)."""
    pairs = {(b, w, y) for text, y in rows for b, w in zip(["", *text.split()], text.split(), strict=False)}
    counts = ({}, {})
    for _, w, y in pairs:
        s = " " + w + " "
        for at in range(1, len(s)):
            g = s[max(0, at - order + 1) : at + 1].encode()
            counts[y][g] = counts[y].get(g, 0) + 1
    seen = {*counts[0], *counts[1]}
    tails, kinds = {g.rjust(order, b"\0") for g in seen}, {}
    for n in range(order - 1, 0, -1):
        kinds[n] = Counter(t[1:] for t in tails)
        tails = set(kinds[n])

    sums = {}
    for n, own in kinds.items():
        for t, k in own.items():
            old = sums.get((n, t[:-1]), (0, 0))
            sums[n, t[:-1]] = (old[0] + k, old[1] + 1)

    def shared(t):
        if not t:
            return 1 / 256
        total, types = sums[len(t), t[:-1]]
        return (max(kinds[len(t)][t] - discount, 0) + discount * types * shared(t[1:])) / total

    contexts = [{}, {}]
    for y in (0, 1):
        for g, n in counts[y].items():
            old = contexts[y].get(g[:-1], (0, 0))
            contexts[y][g[:-1]] = (old[0] + n, old[1] + 1)

    def ratio(g):
        p = []
        for y in (0, 1):
            total, types = contexts[y].get(g[:-1], (0, 0))
            back = discount * types / total if total else 1.0
            low = shared(g.rjust(order, b"\0")[1:]) if g in seen else 1.0  # one factor for both classes
            p.append((max(counts[y].get(g, 0) - discount, 0) / total if total else 0.0) + back * low)
        return math.log(p[1] / p[0])

    return ratio, seen


def packed_gram(g):
    return int.from_bytes(g, "big")


@pytest.mark.parametrize("many", [False, True])
def test_kneser_ney_model(spark, many):
    """Ratios of all n-grams against the formulas; an n-gram never seen has what its context gives, or nothing."""
    own = random.Random(11)
    rows = [("ab ab ac", 1), ("ab ad ad", 0), ("b", 0)]
    if many:
        rows = [(" ".join("".join(own.choice("abcdefghij") for _ in range(own.randrange(1, 8))) for _ in range(60)), k % 2) for k in range(80)]
    ratio, seen = written_out_model(rows)
    words = toxicity.word_counts(spark.createDataFrame(rows, "text string, label int"))
    model = toxicity.ratios(stored(toxicity.gram_counts(words))).toArrow()
    table = toxicity.Table(model.column(0).to_numpy(), model.column(1).to_numpy())
    keys = np.array([packed_gram(g) for g in sorted(seen)], np.uint64)
    assert len(seen) > (5000 if many else 5)
    assert toxicity.byte_ratios(keys, table) == pytest.approx([ratio(g) for g in sorted(seen)], rel=1e-3, abs=1e-4)
    never = [g[:-1] + b"\xc3" for g in sorted(seen)]  # no byte of the corpus is above 127
    assert toxicity.byte_ratios(np.array([packed_gram(g) for g in never], np.uint64), table) == pytest.approx([ratio(g) for g in never], rel=1e-3, abs=1e-4)
    assert not toxicity.byte_ratios(np.array([packed_gram(b"\xc3\xa4\xc3\xa4\xc3\xa4")], np.uint64), table).any()
    text = rows[0][0]
    grams = [(" " + w + " ")[max(0, at - 5) : at + 1].encode() for w in text.split() for at in range(1, len(w) + 2)]
    sums, n = toxicity.word_sums([text.encode()], table)
    assert sums.sum() == pytest.approx(sum(map(ratio, grams)), rel=1e-3, abs=1e-3) and n.tolist() == [len(text.split())]


def test_word_pairs_are_dealt_out_sorted_in_few_bytes(spark, monkeypatch):
    """A word's rows stand beside each other, with one value for the word and the hash of the word before, and count as before."""
    sent, through = [], toxicity.in_arrow

    def kept(df, run, schema):
        sent.append(through(df, run, schema).collect())
        return through(df, run, schema)

    monkeypatch.setattr(toxicity, "in_arrow", kept)
    rows = [("b a b a c", 0), ("a b b", 0), ("c b é a", 1), (None, 1)]
    got = toxicity.word_counts(spark.createDataFrame(rows, "text string, label int").coalesce(1)).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, 2), ("b", 1, 3), ("c", 1, 1), ("é", 1, 0)]
    plain = [bytes(r[0])[:-4] for r in sent[0] if r[1] == 1]
    assert plain == sorted(plain) and len(plain) == 6


def test_evidence_is_the_best_passage():
    sums, n = np.array([1.0, 5.0, -2.0, 4.0, 7.0, -1.0]), np.array([3, 0, 1, 2])
    for passage in (1, 2, 3, 5):
        want, at = [], 0
        for size in n.tolist():
            x = sums[at : at + size]
            at += size
            want.append(max((x[i : i + passage].mean() for i in range(max(1, size - passage + 1))), default=0.0) if size else 0.0)
        assert toxicity.evidence(sums, n, passage).tolist() == pytest.approx(want)


def test_a_model_in_parts_scores_alike(spark, awkward):
    df, known = labelled(spark, "toxic")
    whole = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(df, known).collect()}
    parts = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(df, known, entries=700).collect()}
    assert parts == pytest.approx(whole, abs=1e-4)
    assert toxicity.toxicity_scores(awkward, known, entries=700).count() == len(AWKWARD)


def test_likely_keeps_every_listed_id(spark):
    ids = stored(spark.range(0, 100_000, 7).toDF("_id"))
    left = common.likely(spark.range(100_000).withColumn("_page", F.lit("clash")), "id", ids, "_id")
    got = {r[0] for r in left.select("id").collect()}
    assert got >= set(range(0, 100_000, 7)) and len(got) < 30_000
    assert common.likely(spark.range(10), "id", stored(ids.limit(0)), "_id").count() == 0


def test_quality(spark, awkward, empty, labels):
    df, known = labelled(spark, "quality")
    check_scores(quality.quality_scores(df, known).collect(), dict(known.collect()), 0.3)
    got = quality.quality_scores(awkward, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in AWKWARD)
    assert quality.good_documents(awkward, labels).columns == awkward.columns
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}


def test_dual_coordinate_descent():
    """The weights of the support vectors against the dual solved by projected gradients."""
    own = np.random.default_rng(5)
    rows = [np.unique(own.integers(0, 40, 12)) + (k % 2) * 5 for k in range(24)]
    y = np.array([1 if k % 2 else -1 for k in range(24)]) * np.where(own.random(24) < 0.15, -1, 1)
    model = quality.SupportVectors(rows, (y > 0).astype(int), epochs=400)
    x = np.zeros((24, 64))
    for k, f in enumerate(rows):
        x[k, f] = model.ratio[f] / np.sqrt((model.ratio[f] ** 2).sum())
    gram = (x @ x.T) * np.outer(y, y)
    alpha = np.zeros(24)
    for _ in range(60_000):
        alpha = np.clip(alpha - 0.05 * (gram @ alpha - 1), 0, quality.COST)
    want = (alpha * y) @ x
    assert model.weights[:64] == pytest.approx(want, abs=2e-3) and not model.weights[64:].any()
    primal = lambda w: 0.5 * w @ w + quality.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    assert primal(model.weights[:64]) == pytest.approx(alpha.sum() - 0.5 * alpha @ gram @ alpha, rel=1e-3)


# 7 licenses


def test_licenses(docs, awkward, empty, spark):
    texts = [
        "The MIT  License; the mit-license and (Apache License). GENERAL public\nlicense mit license",
        "permit license", "mit licensed", "released undr the mit licence by us", "all right reserved", "ALL RIGHTS RESERVED", "mitä license",
        "Permission is hereby grated, free of charge, to any persn obtaining", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("x"))
    for source in (df, awkward, docs):
        for r in licenses.license_report(source.select("doc_id", "text")).collect():
            text = {k: t for k, t in documents_of(source)}[r["doc_id"]]
            w = words(text)
            hits = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
            assert r["base_labels"] == ",".join(sorted({h[1] for h in hits})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
            assert 0 <= r["score"] <= 1
    got = {r["doc_id"]: (r["labels"], r["score"], r["notices"]) for r in licenses.license_report(df).collect()}
    assert got[3][0] == "mit" and got[3][2][0]["edits"] == 2 and got[3][2][0]["word"] == 0 and got[3][2][0]["words"] == 5
    assert got[4][0] == got[5][0] == "rights-reserved" and got[4][1] < got[5][1] == 1.0
    assert "permissive-grant" in got[7][0] and got[1] == got[2] == got[9] == ("", 0.0, [])
    assert licenses.license_report(empty).count() == 0


def test_every_notice_of_a_text_is_found():
    notices = list(licenses.NOTICES)
    for _ in range(60):
        parts, want = [], []
        for _ in range(rng.randrange(1, 7)):
            notice, s = rng.choice(notices), None
            for _ in range(rng.randrange(0, len(notice) // licenses.CHARS_PER_EDIT + 1)):
                s = s or list(notice)
                k = rng.choice([i for i, c in enumerate(s) if c.isalpha() and 0 < i < len(s) - 1])
                s[k] = rng.choice("xyzq")
            filler = ["word"] * rng.randrange(0, 4)
            want.append((notice, sum(len(p.split()) for p in parts) + len(filler)))
            parts += [" ".join(filler), "".join(s or notice)]
        n_words, _, found = licenses.scan(" ".join(parts).encode(), {}, licenses.NOTICES)
        assert n_words == len(" ".join(parts).split()) and {(n, w) for n, w, *_ in found} >= set(want)
    line = b"mit license " * 30_000 + b"all rights reserved " * 3_000  # word numbers come in one pass
    n_words, base, found = licenses.scan(line, licenses.PHRASES, licenses.NOTICES)
    assert (n_words, len(base), base[-1][0], len(found), found[-1][1]) == (69_000, 30_000, 59_998, 3_000, 68_997)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_notice_within_the_bound_is_lost():
    """Edits anywhere and at both ends, in and beside other words, against the distance of every span of whole words."""
    own = random.Random(3)
    for notice in licenses.NOTICES:
        bound = len(notice) // licenses.CHARS_PER_EDIT
        assert licenses.scan(f"x {notice}s y".encode(), {}, {notice: "n"})[2] == [(notice, 1, len(notice.split()), 1, notice + "s")]
        assert licenses.scan(f"x{notice}".encode(), {}, {notice: "n"})[2] == [(notice, 0, len(notice.split()), 1, "x" + notice)]
        for trial in range(80):
            s = list(notice)
            for _ in range(own.randrange(1, bound + 2)):
                at, kind = own.choice([0, len(s), len(s) - 1, own.randrange(len(s))]) if trial % 2 else own.randrange(len(s)), own.randrange(3)
                s[at : at + (kind > 0)] = [] if kind == 2 else own.choice(["x", "s", "s", " ", "ä", "語"])
            beside = [" ".join(own.choice(["a", "of", "word", "s"]) for _ in range(own.randrange(3))) for _ in range(2)]
            w = words(f"{beside[0]} {''.join(s)} {beside[1]}")
            want = {(i, j - i): d for i in range(len(w)) for j in range(i + 1, len(w) + 1) if abs(len(t := " ".join(w[i:j])) - len(notice)) <= bound and (d := distance(t, notice)) <= bound}
            found = licenses.scan(" ".join(w).encode(), {}, {notice: "n"})[2]
            assert bool(found) == bool(want) and all(want[at, n] == e for _, at, n, e, _ in found), w
            assert min((e for *_, e, _ in found), default=None) == min(want.values(), default=None), w
            covered = {k for _, at, n, _, _ in found for k in range(at, at + n)}
            assert all(covered & set(range(at, at + n)) for at, n in want), w
    for text in ("xredistribution and use xn source and binary forms", "released txhe sxoftware is provided as is without warranxy of any kinyd"):
        assert licenses.scan(text.encode(), {}, licenses.NOTICES)[2], text


# 8 top-k


def plain_top(rows, asked, k=10):
    whole = lambda v: [math.floor(1024 * x) for x in v]
    good = lambda i, v: i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    candidates, out = [(i, whole(v)) for i, v in rows if good(i, v)], []
    for q, v in ((i, whole(v)) for i, v in asked if good(i, v)):
        scores = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in candidates if i != q and len(c) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_own_rows_take_no_place_in_a_leaf():
    """A query's own id stands many times beside its candidates; ties in a leaf go to the smaller ids."""
    own = random.Random(8)
    for copies in (2, 11, 30):
        rows = [(7, [3, 4])] * copies + [(100 - i, [3, 4 - i % 3]) for i in range(30)] + [(200 + i, [own.randrange(-2, 3), own.randrange(-2, 3)]) for i in range(200)]
        own.shuffle(rows)
        tree = mtree.MTree(np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.float64))
        want = sorted((-(3 * v[0] + 4 * v[1]), i) for i, v in rows if i != 7)[:10]
        assert tree.search(np.array([3.0, 4.0]), 7, 10) == [(-s, i) for s, i in want]


def test_top_k(spark):
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [0.5, 0.5]), (2004, [0.25, 0.5]), (2005, []), (None, [1.0] * 8), (2007, [float("inf")] * 8)]
    rows += [(100, [rng.gauss(0, 0.2) for _ in range(8)]), (120, rows[5][1]), (120, rows[5][1])]  # ids on rows that differ, and repeated rows
    rows += [(3000 + i, [rng.uniform(-3e5, 3e5) for _ in range(8)]) for i in range(20)]  # sums beyond 2 ** 53
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("row", F.lit("x"))
    is_asked = lambda i: i is not None and (i % 20 == 0 or i in (2001, 2003, 2005))
    chosen = df.where("vec_id % 20 = 0 or vec_id in (2001, 2003, 2005)")
    want = plain_top(rows, [r for r in rows if is_asked(r[0])])
    assert max(abs(w[3]) for w in want) > 2**53
    for shard, block in ((90, 7), (100_000, 1000)):
        got = mtree.top_k(df, chosen, shard=shard, block=block)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert mtree.top_k(df.limit(0), chosen.limit(0)).count() == 0 and mtree.top_k(df, chosen.limit(0)).count() == 0


def test_floor_and_bounds_spare_rows():
    """The tree scores fewer rows than there are, and fewer still below a floor, with the same answers."""
    own = np.random.default_rng(4)
    centres = own.integers(-300, 300, (30, 8))
    vectors = np.concatenate([c + own.integers(-12, 12, (200, 8)) for c in centres])
    tree, spared = mtree.MTree(np.arange(len(vectors)), vectors), 0
    for q in range(0, len(vectors), 211):
        free = tree.search(vectors[q], q, 10)
        scored = tree.scored
        scores = vectors @ vectors[q]
        scores[q] = -(2**62)
        order = np.lexsort((np.arange(len(vectors)), -scores))[:10]
        assert free == [(int(scores[i]), int(i)) for i in order]
        assert tree.search(vectors[q], q, 10, free[-1][0]) == free and tree.scored <= scored < len(vectors)
        assert tree.search(vectors[q], q, 10, free[3][0] + 1) == [f for f in free if f[0] > free[3][0]]
        spared += scored < len(vectors) / 2
    assert spared > 10


# 10 line dedup


def normal(line):
    return " ".join(lower(line).replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")).split() and " ".join(x for x in regex.split(r"[ \t\r\x0b\x0c]+", lower(line)) if x)


def plain_lines(rows):
    """Every pair of distinct lines compared; the result of keeping one line of each class."""
    seen = [(k, i, n, normal(x) or "") for k, (i, t) in enumerate(rows) if t is not None for n, x in enumerate(t.split("\n"))]
    distinct = sorted({s[3] for s in seen} - {""})
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in distinct]
    part = classes(len(distinct), [(a, b) for a in range(len(distinct)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    at = {x: c for x, c in zip(distinct, part, strict=True)}
    kept = {}
    for k, i, n, x in sorted(seen, key=lambda s: (s[1] is None, s[1] or 0, s[0], s[2])):
        if x:
            kept.setdefault(at[x], (k, n))
    out = Counter()
    for k, (i, t) in enumerate(rows):
        own = [x for n, x in enumerate(t.split("\n")) if not normal(x) or kept[at[normal(x)]] == (k, n)] if t is not None else None
        out[i, "\n".join(own) if own is not None else None] += 1
    return out


def test_line_dedup(spark, docs, awkward, empty):
    for df in (docs, awkward):
        got = line_dedup.line_dedup(df)
        assert got.columns == [*df.columns, "_lines"]
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == plain_lines(documents_of(df))
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("lines", [8, 3])
def test_line_blocks(spark, monkeypatch, lines):
    """Candidate components cut into groups by band and into blocks give the same lines."""
    base, other = prose(40), prose(40)
    rows = [edited(base, 1) for _ in range(60)] + [edited(other, rng.randrange(7)) for _ in range(40)] + [edited(base, 5) for _ in range(20)]
    df = stored(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    monkeypatch.setattr(line_dedup, "GROUP_LINES", lines)
    steps, compared = [], line_dedup._compared
    monkeypatch.setattr(line_dedup, "_compared", lambda groups, threshold, cross=False: steps.append((cross, groups.groupBy("group", "pair").count().agg(F.max("count")).first()[0])) or compared(groups, threshold, cross))
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(df).collect())
    want = plain_lines(documents_of(df))
    assert sum((got - want).values()) <= 2  # what banding may miss; none of what it proposes is lost
    assert len(steps) >= 3 and any(cross for cross, _ in steps)


def test_verified_links_lose_none(spark, monkeypatch):
    """All links between lines that share a band, at every block size."""
    base = prose(30)
    lines = sorted({normal(edited(base, rng.randrange(8))) for _ in range(120)})
    keys = line_dedup.band_keys([x.encode() for x in lines])
    ids = [line_dedup.line_id(x.encode()) for x in lines]
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    near = [(a, b) for a in range(len(lines)) for b in range(a) if (keys[a] == keys[b]).any() and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = classes(len(lines), near)
    texts = stored(spark.createDataFrame([(1, i, x) for i, x in zip(ids, lines, strict=True)], "component long, lid long, line string"))
    at = {i: k for k, i in enumerate(ids)}
    for size in (4, 20):
        monkeypatch.setattr(line_dedup, "GROUP_LINES", size)
        links = line_dedup.verified_links(texts, 0.8).collect()
        assert classes(len(lines), [(at[r["u"]], at[r["v"]]) for r in links]) == want


@pytest.mark.parametrize("held", [500_000, 700])
def test_postings_travel_packed(spark, monkeypatch, held):
    """A row holds many band keys, and each line still meets all others of its keys, over tasks, flushes and ranges."""
    base = prose(40)
    lines = sorted({normal(edited(base, k % 9)) for k in range(150)} | {normal(prose(20)) for _ in range(250)})
    keys = line_dedup.band_keys([x.encode() for x in lines])
    holders = {}
    for i, own in enumerate(keys.tolist()):
        for key in own:
            holders.setdefault(key, []).append(i)
    want = classes(len(lines), [(x[0], y) for x in holders.values() for y in x[1:]])
    rng.shuffle(order := list(range(len(lines))) * 3)
    df = spark.createDataFrame([("\n".join(lines[i] for i in order[k : k + 6]),) for k in range(0, len(order), 6)], "text string").repartition(4)
    monkeypatch.setattr(line_dedup, "HELD", held)
    monkeypatch.setattr(line_dedup, "RANGES", 16, raising=False)
    packed = line_dedup._postings(df)
    assert packed.count() < keys.size / 5
    at = {line_dedup.line_id(x.encode()): i for i, x in enumerate(lines)}
    links = {(at[r["u"]], at[r["v"]]) for r in common.in_arrow(packed, line_dedup._candidates, "u long, v long").collect()}
    assert classes(len(lines), sorted(links)) == want


def test_links_of_a_large_group_are_few(spark):
    """Comparing makes rows for the links that join classes only, none for lines by themselves, and loses no class."""
    base = prose(30)
    lines = sorted({normal(edited(base, 2 * k % 7)) for k in range(60)} | {normal(prose(20)) for _ in range(40)})
    sets = line_dedup.shingle_sets([x.encode() for x in lines])
    near = [(a, b) for a in range(len(lines)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
    want, ids = classes(len(lines), near), list(range(len(lines)))
    links = line_dedup._cross_links(ids, sets, ids, [True] * len(ids), 0.8)
    assert classes(len(lines), links) == want and len(links) == len(lines) - len(set(want))
    rows = spark.createDataFrame([(1, 0, i, i, True, x) for i, x in enumerate(lines)], "group long, pair long, lid long, class long, probe boolean, line string")
    made = [(r["u"], r["v"]) for r in line_dedup._compared(rows, 0.8).collect()]
    assert classes(len(lines), made) == want and len(made) == len(lines) - len(set(want))


def test_ids_of_rows_are_written_once(spark):
    """Filtered and repartitioned plans, whose rows come in another order at every scan, are judged like stored tables."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 7 <> 3").repartition(5)
    rows = documents_of(df)
    assert Counter((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(df).collect()) == plain_lines(sorted(rows))
    low = plain_components(rows)
    want = sorted({c for _, _, c in low})
    got = simhash.simhash_dedup(df)
    assert sorted(r["doc_id"] for r in got.collect()) == want and got.columns == df.columns


def test_band_recall():
    lines = [prose(45).encode() for _ in range(400)]
    near = [edited(x.decode(), 2).encode() for x in lines]
    a, b = line_dedup.band_keys([line_dedup.normal_lines(x)[0] for x in lines]), line_dedup.band_keys([line_dedup.normal_lines(x)[0] for x in near])
    fit = met = 0
    for i, (x, y) in enumerate(zip(lines, near, strict=True)):
        s, t = line_dedup.shingles(line_dedup.normal_lines(x)[0]), line_dedup.shingles(line_dedup.normal_lines(y)[0])
        if len(np.intersect1d(s, t)) >= 0.8 * len(np.union1d(s, t)):
            fit, met = fit + 1, met + bool((a[i] == b[i]).any())
    assert fit > 100 and met >= 0.97 * fit
