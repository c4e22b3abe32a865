import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import archives, chat, chunks, common, decontaminate, licenses, lines, mixing, rules, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n_words string, key string, lang string, n_chars long"
rng = random.Random(5)
VOCAB = ["the", "of", "inter", "nation", "Élan", "größe", "river", "stone", "cloud", "a", "mit", "und", "blé", "yes", "seven"]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def table(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, s, "clash", "clash", "en", None if t is None else len(t)) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, "   \n\n", "a"), (None, "one lonely text without an id", None), (4, "same text here\nwith two lines of it", "b"), (4, "same text here\nwith two lines of it", "b"), (5, "word " * 30_000, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def distance(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


def groups(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# connected components


def test_components_of_chains_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(-3, 7), (7, 9), (9, -3), (8, 8)]
    out = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == groups({x for p in pairs for x in p} - {8}, [p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# op 1


def test_escape_round_trip():
    r = random.Random(1)
    pieces = [*chat.CONTROL, "\\", "<", "[", "\\l", "\\<|", "x", "\n", "é", "</s", ">", "INST]"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
        assert chat.parse_turn(chat.format_turn(text, text[::-1])[0]) == (text, text[::-1])


def test_prefix_tree_places_positions_and_attention(spark):
    r = random.Random(2)
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", r.choice("abc") * r.randrange(3)) for c in range(120) for t in range(r.randrange(1, 6))]
    talk += [(None, 0, "user", "nobody"), (7, None, None, None), (7, 9, "assistant", "</s>[INST]"), (7, 9, "assistant", "</s>[INST]")]
    nodes, members = chat.prefix_tree(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    node = {n.node_id: n for n in nodes.collect()}
    assert len(node) == nodes.count()
    paths = {}
    for m in members.collect():
        paths.setdefault(m.conv_id, {})[m.depth] = m.node_id
    trees = {}
    for n in node.values():
        trees.setdefault(n.tree, []).append(n)
    for tree in trees.values():  # places fill the tree's sequence without gap or overlap, parents first
        at = 0
        for n in sorted(tree, key=lambda n: n.place):
            assert n.place == at and (n.parent_id is None or node[n.parent_id].place < n.place)
            at += len(n.tokens)
    for path in paths.values():
        before = []
        for d in range(len(path)):
            n = node[path[d]]
            seen = [i for a in n.ancestors for i in range(a.start, a.end)]
            assert seen == before and n.position_ids == list(range(len(before), len(before) + len(n.tokens)))
            before += range(n.place, n.place + len(n.tokens))
    back = {r.conv_id: r for r in chat.read_back(nodes, members).collect()}
    for c in {t[0] for t in talk} - {None}:
        own = sorted((t for t in talk if t[0] == c), key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        told = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert back[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and back[c].n_turns == len(own)
        assert back[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and back[c].loss_chars == len(loss)
        assert back[c].positions_count_up and back[c].attends_to_its_past
        assert back[c].n_shared_turns == sum(node[x].n_conversations > 1 for x in paths[c].values())
    assert any(r.n_shared_turns for r in back.values())
    # what the tree says is read, not assumed
    wrong = nodes.withColumn("position_ids", F.transform("position_ids", lambda x: x + 1))
    assert not any(r.positions_count_up for r in chat.read_back(wrong, members).collect() if r.n_turns)
    wrong = nodes.withColumn("ancestors", F.slice("ancestors", 2, 99))
    assert not all(r.attends_to_its_past for r in chat.read_back(wrong, members).collect())


def test_prefix_tree_with_clashing_columns_and_a_very_long_text(spark):
    names = "conv_id long, turn long, role string, text string, node_id string, depth long, owner string, place string"
    talk = [(c, t, "assistant", "long words <| " * (20_000 if t else 1), "x", 1, "x", "x") for c in (1, 2) for t in (0, 1)]
    nodes, members = chat.prefix_tree(spark.createDataFrame(talk, names))
    assert nodes.count() == 2 and members.count() == 4
    want = "".join(f"assistant\n{t[3]}\n" for t in talk[:2])
    assert [(r.turns_sha256, r.n_shared_turns) for r in chat.read_back(nodes, members).collect()] == [(hashlib.sha256(want.encode()).hexdigest(), 2)] * 2


def test_shared_turns_are_tokenised_once_and_their_sql_agrees(spark, tmp_path):
    import duckdb

    from sightline.llm import queries

    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c // 4 if t < 2 else c} [INST]") for c in range(40) for t in range(4)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows(queries.op1_prefix_tree(spark, str(tmp_path)).select(*(columns := "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars n_shared_turns positions_count_up attends_to_its_past".split())))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE['op1_prefix_tree']})").fetchall(), key=repr)
    assert {x[6] for x in got} == {0, 2}


def test_prefix_tree_is_depth_first_and_shares(spark):
    talk = [(1, 0, "user", "x"), (1, 1, "assistant", "y"), (2, 0, "user", "x"), (2, 1, "assistant", "z"), (3, 0, "user", "x"), (3, 1, "assistant", "y"), (3, 2, "user", "w")]
    nodes, _ = chat.prefix_tree(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    order = [chat.parse_turn(n.segment)[1] for n in sorted(nodes.collect(), key=lambda n: n.place)]
    assert order == ["x", "y", "w", "z"]


def test_prefix_tree_of_nothing(spark):
    nodes, members = chat.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 0 and chat.read_back(nodes, members).count() == 0


# op 2


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, hit = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(5)}
    full = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(hit)


def test_rule_ledger_against_brute_force(spark):
    r = random.Random(3)
    texts = [prose(r.randrange(40), r) for _ in range(60)] + ["a b c d e " * 4, "a a a a a a a", "x\v y\f z\r#|<>", "tail # of\n\nline\nline\n line"]
    data = [*((i, t, "s") for i, t in enumerate(texts)), *((i, t[:3000] if t else t, s) for i, t, s in ODD)]
    got = rows(rules.judged(table(spark, data)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = [(i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, t, _ in data for m in [measures(t)]]
    assert got == sorted(want, key=repr)


def test_ablations(spark):
    ledger = rules.ledger(table(spark, [(1, "too short", "s"), (2, "x# y# " * 2 + "z", "s"), (3, "one two three four five six seven eight nine ten eleven", "s")]))
    out = {r.rule: r for r in rules.ablations(ledger, rules.CURRENT).collect()}
    assert (out["too_few_words"].n_failed, out["too_few_words"].n_only, out["too_few_words"].kept_with, out["too_few_words"].kept_without) == (2, 1, 1, 2)
    assert out["upper_case"].kept_without == 1


def test_rules_of_nothing(none):
    assert rules.judged(none).count() == 0


# op 3


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    both = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "toxic", "score").collect()
    assert len(both) > 50 and np.mean([r.predicted == r.toxic for r in both]) > 0.95
    assert all(0 <= r.score <= 1 for r in both)


def plain_ftrl(data, settings):
    """Weights by feature, one coordinate at a time. data: (features, label)."""
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << toxicity.BITS else settings.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return ((l1 if z[i] > 0 else -l1) - z[i]) / ((settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(settings.passes):
        for at, label in data:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / settings.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i)) != 0}


def test_toxicity_against_a_plain_ftrl(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.filter("toxic is not null").filter(~toxicity.held_out(F.col("doc_id")))
    ordered = docs.join(known, "doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").collect()
    data = [([*sorted(set(toxicity.features((r.text or "").encode()).tolist())), 1 << toxicity.BITS], r.toxic) for r in ordered]
    want = plain_ftrl(data, toxicity.Settings())
    got = toxicity.fit(docs, labels)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want) and len(want) > 5
    bias = want.get(1 << toxicity.BITS, 0.0)
    for r in toxicity.score(docs, labels).join(docs, "doc_id").limit(60).collect():
        x = bias + sum(want.get(i, 0.0) for i in set(toxicity.features((r.text or "").encode()).tolist()))
        assert abs(r.score - 1 / (1 + np.exp(-x))) < 1e-9 and r.predicted == (r.score >= toxicity.THRESHOLD)


def test_held_out_recall(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    both = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r.toxic: r.share for r in both}
    assert share[1] > 0.88 and share[0] < 0.01


def test_labels_that_are_held_out_teach_nothing(spark):
    docs = table(spark, [(i, "awful text" if i % 2 else "fine text", "s") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(toxicity.score(docs, labels)) == rows(toxicity.score(docs, flipped))


def test_toxicity_of_odd_rows_and_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(odd, labels).collect()] == [0.5] * len(ODD)
    assert toxicity.drop_toxic(odd, labels).count() == len(ODD)
    assert toxicity.score(none, labels).count() == 0


def test_words_at_the_end_of_a_very_long_text_are_learned(spark, monkeypatch):
    r = random.Random(18)
    long = " ".join(f"w{r.randrange(500)}" for _ in range(45_000)) + " awful wording"
    assert (toxicity.present(long.encode()) == np.unique(toxicity.features(long.encode()))).all()
    for size in (1, 2, 7):
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert (toxicity.present(b"one two three four five six seven eight") == np.unique(toxicity.features(b"one two three four five six seven eight"))).all()
    monkeypatch.undo()
    clean = "plain " * 20_000
    docs = table(spark, [(i, clean + ("awful wording" if i % 2 else "fine prose"), "s") for i in range(120)] + [(1000, "awful wording", "s"), (1001, "fine prose", "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    score = {x.doc_id: x.score for x in toxicity.score(docs, labels).collect()}
    assert score[1000] > score[1001] + 0.2


# op 4


def test_archives_round_trip(spark, tmp_path):
    big = "x\r\n\r\nWARC/1.1\r\n" * 100
    pages = [(1, "http://a b/\n", big, "c"), (2, None, big, "c"), (3, "", None, "c"), (4, "u", "é" * 600, "c"), (None, "v", big, "c"), (5, "w", "short", "c"), (6, "w", "short", "c"), (6, "w", "short", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_id string")
    got = rows(archives.convert(df, str(tmp_path / "a")))
    want = []
    for i, _, html, _ in pages:
        body = (html or "").encode()
        later = html == big and i != 2
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if later else "response", 2 if later else None))
    assert got == sorted(want, key=repr)
    assert archives.convert(df.limit(0), str(tmp_path / "b")).count() == 0


def test_arc_versions_and_broken_lengths():
    one = b"filedesc://x 0.0.0.0 2024 text/plain 76\n1 0 me\n" + archives.ARC_FIELDS[1].encode() + b"\n"
    one = one.replace(b" 76\n", f" {len(one.partition(b'\n')[2])}\n".encode())
    two = b"filedesc://y 0.0.0.0 2024 text/plain LEN\n2 0 me\n" + archives.ARC_FIELDS[2].encode() + b"\n"
    two = two.replace(b"LEN", str(len(two.partition(b"\n")[2])).encode())
    data = one + b"\nhttp://a 1.2.3.4 20200102030405 text/html 5\nab\ncd\n" + two + b"\nhttp://b 1.2.3.4 20200102030405 text/html 200 - - 0 f 3\nxyz\n"
    whole = [(1, "http://a", b"ab\ncd"), (2, "http://b", b"xyz")]
    records = lambda data, faults=None: [(v, f["URL"], c) for v, f, c in archives.parse_arc(data, faults) if not f["URL"].startswith("filedesc")]
    assert records(data) == whole
    for bad, left in ((data.replace(b"/html 5\n", b"/html five\n"), whole[1:]), (data[:-6], whole[:1]), (data.replace(b"http://b 1.2.3.4", b"http://b"), whole[:1]), (b"junk\n\nmore junk 12\n" + data, whole)):
        faults = []
        assert records(bad, faults) == left and faults
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-6]))


def test_short_and_impossible_dates():
    assert [archives.iso_date(x) for x in ("1997", "199701", "19970230", "20240229235960", "00000000000000", "19971340256199")] == [
        "1997-01-01T00:00:00Z", "1997-01-01T00:00:00Z", "1997-02-28T00:00:00Z", "2024-02-29T23:59:59Z", "0001-01-01T00:00:00Z", "1997-12-31T23:59:59Z",
    ]


def test_records_of_every_kind_through_the_converter(spark, tmp_path):
    import gzip

    body = b"x" * 1200
    http = b"HTTP/1.0 200 OK\r\nContent-Length: 1200\r\n\r\n" + body
    about = f"1 0 me\n{archives.ARC_FIELDS[1]}\n".encode()
    records = [(b"dns:a", b"9.8.7.6", b"199701", b"text/dns", b"20240101\na. IN"), (b"http://a/", b"1.2.3.4", b"20240101", b"text/html", http), (b"http://b/", b"1.2.3.4", b"20240102", b"text/html", http), (b"ftp://c/", b"-", b"2024", b"image/gif", body)]
    data = b"filedesc://z.arc 0.0.0.0 2024 text/plain %d\n%s" % (len(about), about) + b"".join(b"\n%s %s %s %s %d\n%s" % (*r[:4], len(r[4]), r[4]) for r in records)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:] + b"\nthis is no header\n"))
    read = archives.read_arc(spark, str(tmp_path / "arc"))
    archives.write_warc(archives.with_revisits(read), str(tmp_path / "warc"))
    assert [(r.at, r.fault[:13]) for r in archives.arc_faults(spark, str(tmp_path / "arc")).collect()] == [(len(data) + 1, "no ARC header")]
    files = [archives.inflated(f.read_bytes()) for f in (tmp_path / "warc").glob("part-*")]
    found = {h.get("warc-target-uri", ""): (h["warc-type"], h["content-type"], h["warc-date"], h.get("warc-ip-address"), block) for f in files for h, block in archives.parse_warc(f)}
    assert found[""] == ("warcinfo", "text/plain", "2024-01-01T00:00:00Z", None, about)
    assert found["dns:a"] == ("resource", "text/dns", "1997-01-01T00:00:00Z", "9.8.7.6", records[0][4])
    assert found["ftp://c/"] == ("resource", "image/gif", "2024-01-01T00:00:00Z", None, body)
    assert {found["http://a/"][0], found["http://b/"][0]} <= {"response", "revisit"} and found["http://a/"][1] == "application/http;msgtype=response"
    back = {(r.record_type, r.payload_bytes, r.payload_digest) for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert ("resource", 1200, hashlib.sha1(body).hexdigest()) in back and ("response", 1200, hashlib.sha1(body).hexdigest()) in back


# op 5


def test_licenses_on_planted_and_odd_rows(spark, none):
    gpl = next(t for label, t in licenses.TEMPLATES if label == "gpl-3")
    texts = [(10, "Cc by-NC cc BY nc; under the MIT License", "s"), (11, prose(40) + " " + gpl.upper().replace(" ", "\n") + " " + prose(9), "s"), (12, " ".join(gpl.split()[:6]), "s"), (13, "under theK mit license mitt", "s")]
    out = {r.doc_id: r for r in licenses.scan(table(spark, [*texts, *ODD])).collect()}
    assert (out[10].n_words, out[10].n_base, out[10].first_word, out[10].last_word, out[10].base_labels, out[10].score) == (10, 3, 0, 6, "cc-by-nc,mit", 1.0)
    assert (out[11].n_base, out[11].labels, out[11].score) == (0, "gpl-3", 1.0) and out[12].labels == "" and out[13].n_base == 0
    assert (out[1].n_words, out[1].labels, out[1].first_word) == (0, "", None)
    assert licenses.scan(none).count() == 0


# op 6


def test_fingerprint_of_one_shingle_and_of_bits():
    import xxhash

    assert simhash.fingerprint(b"Only TWO") == xxhash.xxh64_intdigest(b"only two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n\t") == 0
    words = "a b c d e".split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    assert simhash.fingerprint(b" A b\x0bC d\re") == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) > 1.5)


@pytest.mark.parametrize("block", [4096, 8, 2])
def test_links_join_all_that_are_near(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(150)}
    for _ in range(250):
        x = r.choice(sorted(prints))
        for b in r.sample(range(64), r.randrange(1, 5)):
            x ^= 1 << b
        prints.add(x)
    prints = {simhash._signed(x) for x in prints}
    near = [(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    got = common.components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")))
    want = groups(prints, near)
    assert {r.node: r.root for r in got.collect()} == {x: want[x] for p in near for x in p}


def test_similar_texts_meet_by_their_fingerprints(spark):
    r = random.Random(31)
    data = []
    for k in range(12):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
        data.append((10 * k + 1, " ".join(words), "s"))
        words[r.randrange(600)] = "changed"
        data.append((10 * k + 2, " ".join(words), "s"))
    prints = {i: simhash.set_fingerprint(simhash.shingles(t.encode())) for i, t, _ in data}
    near = {10 * k + 2 for k in range(12) if (prints[10 * k + 1] ^ prints[10 * k + 2]).bit_count() <= simhash.BUDGET}
    assert near
    found = dict(rows(simhash.similar_groups(table(spark, [*data, *ODD[:3]]), bands=0)))
    assert all(found[i] == (i - 1 if i in near else i) for i, _, _ in data)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(6)
    long = [prose(300, r) for _ in range(20)]
    texts = long + [t.replace("seven", "eight", 1) for t in long] + long[:5]
    data = [*((i + 100, t, "s") for i, t in enumerate(texts)), *ODD]
    marks = [(i, simhash.fingerprint(t.encode() if t is not None else None)) for i, t, _ in data]
    pairs = [(a, b) for a in {f for _, f in marks} for b in {f for _, f in marks} if a < b and (a ^ b).bit_count() <= 3]
    of = groups({f for _, f in marks}, pairs)
    least = {}
    for i, f in marks:
        least[of[f]] = min((x for x in (least.get(of[f]), i) if x is not None), default=None)
    assert rows(simhash.near_duplicates(table(spark, data))) == sorted(((i, f"{f:016x}", least[of[f]]) for i, f in marks), key=repr)


def test_one_of_each_group_stays(spark, odd, none):
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(odd).collect()]
    assert sorted(kept, key=repr) == sorted([ODD[0][:2], ODD[4][:2], ODD[6][:2], ODD[3][:2]], key=repr)
    assert simhash.drop_near_duplicates(odd).columns == odd.columns and simhash.drop_near_duplicates(none).count() == 0


def test_rows_that_share_an_id_or_have_none_are_told_apart_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    texts = lambda data: sorted(r.text[0] + str(r.doc_id) for r in simhash.drop_near_duplicates(table(spark, [(i, t, "s") for i, t in data])).collect())
    assert texts([(4, a), (4, b), (9, c)]) == ["a4", "b4", "c9"]
    assert texts([(2, a), (4, a), (4, b)]) == ["a2", "b4"]
    assert texts([(None, a), (None, a), (None, b), (7, b), (8, c), (8, c)]) == ["aNone", "b7", "c8"]


@pytest.mark.parametrize("group", [256, 4])
def test_texts_of_similarity_080_are_dropped_and_others_stay(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(16)
    words = [f"w{i}" for i in range(3000)]
    data, sets = [], []
    for k in range(12):
        text = [r.choice(words) for _ in range(150)]
        for c in range(10):
            own = list(text)
            for at in r.sample(range(150), c):  # each replaced word breaks five shingles
                own[at] = r.choice(words)
            data.append((len(data), " ".join(own), "s"))
            sets.append({tuple(own[i : i + 5]) for i in range(146)})
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    marks = [simhash.fingerprint(t.encode()) for _, t, _ in data]
    assert sum((marks[a] ^ marks[b]).bit_count() > 3 for a, b in near) > 20
    got = {x.doc_id for x in simhash.drop_near_duplicates(table(spark, data)).collect()}
    assert got == set(groups(range(len(sets)), near).values())


# op 7


def test_poisson_counts_have_their_mean_and_distribution(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2020, None).otherwise("rest").alias("source"))
    out = mixing.replicate(docs, {"hot": 1.0, "rest": 3.0, "absent": 9.0}, total=12_000)
    by = {r.source: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.first("rate").alias("rate")).collect()}
    rate = {"hot": 12000 / 4 / 2000, "rest": 12000 * 3 / 4 / 3980}  # sources without documents have no share
    assert set(by) == set(rate)
    for s, n in (("hot", 2000), ("rest", 3980)):
        assert abs(by[s].rate - rate[s]) < 1e-9 and abs(by[s].n - n * rate[s]) < 5 * (n * rate[s]) ** 0.5
        assert abs(by[s].d / n - (1 - np.exp(-rate[s]))) < 0.05
    keys = [r.mix_key for r in out.select("mix_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_large_means_are_sums_of_parts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    n = mixing.replicate(docs, total=300 * 50.0).count()
    assert abs(n - 15_000) < 5 * 15_000**0.5


def test_rows_without_an_id_draw_for_themselves(spark):
    docs = table(spark, [(None, f"text {i}", "s") for i in range(1000)])
    out = mixing.replicate(docs, total=1000.0).collect()
    assert abs(len(out) - 1000) < 160 and len({r.mix_key for r in out}) == len(out)


def test_rates_of_very_many_sources_are_joined(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    few = rows(mixing.replicate(docs))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert rows(mixing.replicate(docs)) == few


def test_mix_of_odd_rows(odd, none):
    out = mixing.replicate(odd, total=70.0)
    assert {"replica", "rate", "mix_key"} <= set(out.columns) and out.count() > 20
    assert mixing.replicate(none).count() == 0


def test_registered_mix_moves_whole_documents(spark, monkeypatch):
    from sightline.llm import queries

    kept = []
    monkeypatch.setattr(queries, "cut", lambda df: kept.append(common.cut(df)) or kept[-1])
    out = queries.op7_poisson_mix(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(docs.columns) <= set(kept[0].columns)
    assert out.count() == kept[0].join(docs, docs.columns, "left_semi").count() > 0


# op 8


def test_chunks_cover_and_survive_insertions():
    r = random.Random(8)
    passage = prose(120, r).encode()
    for lead in (b"", b"x", prose(30, r).encode(), "éé".encode()):
        body = lead + passage + prose(20, r).encode()
        ends = chunks.boundaries(body)
        assert ends[-1] == len(body) and all(0 < b - a <= chunks.MOST for a, b in zip([0, *ends], ends, strict=False))
        assert b"".join(body[a:b].decode().encode() for a, b in zip([0, *ends], ends, strict=False)) == body
    parts = lambda body, ends: {body[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    cuts = [parts(body, chunks.boundaries(body)) for body in (passage, b"shift" + passage)]
    assert sum(map(len, cuts[0] & cuts[1])) > 0.7 * len(passage)
    assert chunks.boundaries(b"") == [] and chunks.boundaries(b"z" * 1000)[-1] == 1000


def test_gear_in_parts_equals_the_whole(monkeypatch):
    body = prose(500).encode()
    whole = chunks.boundaries(body)
    monkeypatch.setattr(chunks, "_TEMP", 100)
    assert chunks.boundaries(body) == whole


def test_later_passages_go_and_first_ones_stay(spark):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, own = words(80), [words(60) for _ in range(3)]
    data = [(1, own[0] + " " + passage, "s"), (2, own[1] + " " + passage + " " + own[2], "s"), (3, own[2], "s"), *ODD]
    out = {}
    for x in chunks.dedup_substrings(table(spark, data)).collect():
        out.setdefault(x.doc_id, x)
    assert out[1].text == data[0][1] and not out[1].spans and out[1].n_repeated > 0
    assert own[1][:250] in out[2].text and passage[150:350] not in out[2].text
    assert len(out[3].text) < len(own[2]) and out[1].n_bytes == len(data[0][1])
    assert chunks.dedup_substrings(table(spark, [])).count() == 0


def test_substring_dedup_against_a_dictionary(spark):
    r = random.Random(21)
    passages = [prose(r.randrange(5, 60), r) for _ in range(12)]
    data = [(i, " ".join([prose(r.randrange(40), r), *r.sample(passages, r.randrange(3)), prose(r.randrange(40), r)]), "s") for i in range(80)]
    data += [(7, data[7][1], "s"), (7, data[7][1], "s"), (3, data[9][1], "s"), *(x for x in ODD if x[0] is not None)]
    places = {}
    cut_of = lambda t: list(zip([0, *(ends := chunks.boundaries(t))], ends, strict=False))
    for i, t, _ in data:
        for s, e in cut_of((t or "").encode()):
            places.setdefault((t or "").encode()[s:e], []).append((i, s))
    want = []
    for i, t, _ in data:
        body = (t or "").encode()
        at = [(s, e, min(places[body[s:e]]) != (i, s)) for s, e in cut_of(body) if len(places[body[s:e]]) > 1]

        def long(some):
            out = []
            for s, e in some:
                out = [*out[:-1], (out[-1][0], e, out[-1][2] + 1)] if out and out[-1][1] == s else [*out, (s, e, 1)]
            return [x for x in out if x[1] - x[0] >= chunks.RUN]

        gone = [(s, e) for s, e, _ in long([x[:2] for x in at if x[2]])]
        left = b"".join(body[s:e] for s, e in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(body)], strict=True))
        want.append((i, len(body), sum(n for _, _, n in long([x[:2] for x in at])), gone, None if t is None else left.decode()))
    got = [(x.doc_id, x.n_bytes, x.n_repeated, [tuple(s) for s in x.spans], x.text) for x in chunks.dedup_substrings(table(spark, data)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(x[3] for x in want)


# op 9


def naive(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for name, t in items:
        own = split(t)
        k = min(10, len(own))
        wins = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [1_000_000, 25])
def test_contamination_against_brute_force(spark, most):
    r = random.Random(10)
    say = lambda n: " ".join(r.choice(["ab", "B", "c", "É"]) + r.choice(["", "!", "\n"]) for _ in range(n))
    items = [(i, say(r.choice([0, 2, 4, 8, 9, 10, 12, 15]))) for i in range(12)] + [(3, say(14)), (77, None)]
    data = [*((i + 100, say(r.randrange(60)), "s") for i in range(60)), *((i, t and t[:500], s) for i, t, s in ODD)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for x in decontaminate.annotate(table(spark, data), bench, most).collect():
        got.setdefault(x.doc_id, []).append((x.n_words, sum(s.end - s.start for s in x.spans), list(x["items"])))
    want = {}
    for i, t, _ in data:
        want.setdefault(i, []).append(naive(t, items))
    assert got == want


def test_passages_are_cut_and_mostly_contaminated_documents_go(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    data = [(1, "before " * 30 + item.upper() + " after", "s"), (2, item + " x", "s"), (3, None, "s")]
    out = {r.doc_id: r for r in decontaminate.decontaminate(table(spark, data), bench).collect()}
    assert set(out) == {1, 3} and out[1].text == "before " * 30 + " after" and out[1].n_chars == len(out[1].text)
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_is_the_same_over_one_and_many_shards(spark, odd):
    r = random.Random(19)
    say = lambda n: [f"v{r.randrange(400)}" for _ in range(n)]
    items = [say(12) for _ in range(6)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    data = [(101, " ".join([*items[0], *say(3), *items[5], *say(3)]), "s")]  # 40 % of each, 80 % together
    data += [(102, " ".join([*say(40), *items[5][:6], *items[0], *items[5][6:], *say(40)]), "s")]  # a cut of one joins another
    data += [(103, " ".join([*say(40), *items[0][:6], *items[5], *items[0][6:], *say(40)]), "s"), (104, " ".join(say(50)), "s")]
    data += [(110 + k, " ".join([*say(30), *(w for x in r.sample(items, k % 4) for w in x), *say(10)]), "s") for k in range(20)]
    docs = table(spark, data).unionByName(odd)
    one = rows(decontaminate.decontaminate(docs, bench))
    assert rows(decontaminate.decontaminate(docs, bench, most=12)) == one
    assert 101 not in {x[0] for x in one} and 104 in {x[0] for x in one}


# op 10


def test_banded_distance_against_dynamic_programming(spark):
    r = random.Random(11)
    say = lambda n: "".join(r.choice("abé𝔘") for _ in range(n))
    pairs = []
    for _ in range(600):
        a = say(r.randrange(12))
        b = list(a)
        for _ in range(r.randrange(4)):
            b.insert(r.randrange(len(b) + 1), r.choice("abé𝔘")) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    chars = lambda c: F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    for most in (1, 2, 3):
        out = df.select("a", "b", lines.within(chars("a"), chars("b"), most).alias("d")).collect()
        assert all(x.d == (d if (d := distance(x.a, x.b)) <= most else None) for x in out)


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        at, kind = r.randrange(len(out)), r.randrange(3)
        out[at : at + (kind > 0)] = [r.choice("abcxyzé")] if kind < 2 else []
    return "".join(out)


@pytest.mark.parametrize("dense", [16, 3])
def test_line_classes_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(lines, "DENSE", dense)
    if dense == 3:
        monkeypatch.setattr(lines, "SAMPLE", 1)
        monkeypatch.setattr(lines, "ROW", 0)
        monkeypatch.setattr(lines, "FEW_PAIRS", 0)
    r = random.Random(12)
    base = [" ".join(r.choice(VOCAB) for _ in range(r.choice([2, 4, 6, 14, 20]))) for _ in range(60)]
    every = base + [edited(r.choice(base), r.randrange(4), r) for _ in range(240)]
    for form in ("Order no. {} was sent", "{} is the number of an order", "a line of more than sixty-four characters in which {} stands for a number, and little else"):
        every += [edited(form.format("".join(r.choice("01") for _ in range(7))), r.randrange(2), r) for _ in range(60)]
    data = [*((i, "\n".join(r.sample(every, 9)) + "\n ", "s") for i in range(100, 160)), *ODD]
    out = lines.line_classes(table(spark, data)).collect()
    body = {}
    for i, t, _ in data:
        body.setdefault(i, []).append(t)
    held = {x for _, t, _ in data if t is not None for x in t.split("\n") if x.strip()}
    bound = lambda n: max([0, *(t for low, t in lines.BOUNDS if n >= low)])
    links = [(a, b) for a in held for b in held if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= bound(min(len(a), len(b)))]
    assert len(links) > 40
    of, degree = groups(held, links), {x: 0 for x in held}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    text_of = {(i, n): x for i, ts in body.items() for t in ts if t is not None for n, x in enumerate(t.split("\n"))}
    assert len(out) == sum(len(t.split("\n")) for _, t, _ in data if t is not None)
    first = {}
    for x in sorted(out, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.line_no)):
        line = text_of[x.doc_id, x.line_no]
        if not line.strip():
            assert (x.class_doc, x.class_line, x.n_links, x.kept) == (None, None, 0, True)
            continue
        head = first.setdefault(of[line], (x.doc_id, x.line_no if x.doc_id is not None else None))
        assert (x.class_doc, x.class_line, x.n_links) == (*head, degree[line]) and x.kept == (head in ((x.doc_id, x.line_no), (None, None)))


def test_lines_of_one_template_make_no_pairs_but_near_ones(spark):
    r = random.Random(20)
    for n in (1500, 6000):
        made = [("Copyright 2024 Example Corporation " + "".join(r.choice("0123456789") for _ in range(20)),) for _ in range(n)]
        made += [(f"In a long line that all have in common the number {r.getrandbits(60):015x} alone tells one of them from the others, wherever they stand",) for _ in range(n)]
        near = [(x[0][:-1] + ("1" if x[0][-1] == "0" else "0"),) for x in made[:50]]
        found = lines.candidates(spark.createDataFrame(made + near, "text string")).count()
        assert 50 <= found < 50 + n // 20


def near_copies(n, r):
    """One line in n copies, each with two words of its own."""
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(3, 8))) for _ in range(70)]
    out = []
    for _ in range(n):
        line = list(words)
        for _ in range(2):
            line[r.randrange(len(line))] = "".join(r.choice("etaoinshrdlu") for _ in range(6))
        out.append(" ".join(line))
    return out


def test_near_copies_beyond_the_bound_make_few_pairs(spark):
    made = near_copies(1500, random.Random(8))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*made, made[0][:200] + "x" + made[0][200:]])], "doc_id long, text string")
    pairs = lines.candidates(docs)
    assert pairs.count() < 8 * len(made)
    texts = spark.createDataFrame([(x,) for x in made], "line string").select("line", F.xxhash64("line").alias("id"))
    close = texts.alias("p").join(texts.alias("q"), F.col("p.id") > F.col("q.id")).filter(F.levenshtein("p.line", "q.line", 2) >= 0)
    close = close.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    assert close.join(pairs, ["a", "b"], "left_anti").isEmpty()
    linked = lines.line_classes(docs).filter(F.col("doc_id").isin(0, len(made))).select("class_doc", "n_links").collect()
    assert [r["class_doc"] for r in linked] == [0, 0] and all(r["n_links"] for r in linked)


def test_pairs_are_made_by_the_counts_of_all_letters(spark):
    docs = spark.createDataFrame([(x,) for x in near_copies(1500, random.Random(8))], "text string")
    assert lines.candidates(docs).count() < 500


def test_lines_of_one_key_meet_in_one_row_each(spark):
    rows = [(1, i, 200 + (i % 2)) for i in range(900)] + [(2, 1, 201), (3, 1, 200), (3, 2, 200), (4, 5, 201), (4, 5, 200)] + [(7, i, 201) for i in range(300)] + [(8, 3, 200)]
    keyed = spark.createDataFrame(rows, "key long, id long, facts int").repartition(3)
    dense = spark.createDataFrame([(7,), (8,)], "key long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = lines._meeting(keyed.select("key", (F.col("id") + 0).alias("id"), "facts"), dense)
        out = met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r.key, r.id, r.facts) for r in out if r.facts >= 0) == sorted(rows[:900])
    assert sorted(r.id for r in out if r.facts < 0) == sorted([*range(300), 3])
    # both sides of the join read keys that are made once
    assert "ReusedExchange" in plan


def test_lines_are_looked_up_by_a_shuffle_as_well(spark, monkeypatch):
    r = random.Random(21)
    made = near_copies(80, r) + [f"The report of department no. {r.getrandbits(40):010x} was sent" for _ in range(120)]
    made += [edited(r.choice(made), r.randrange(1, 3), r) for _ in range(80)]
    monkeypatch.setattr(lines, "SAMPLE", 1)
    monkeypatch.setattr(lines, "FEW_PAIRS", 0)
    docs = spark.createDataFrame([(i, "\n".join(made[i : i + 3])) for i in range(len(made))], "doc_id long, text string")
    sent = rows(lines.line_classes(docs))
    monkeypatch.setattr(lines, "BROADCAST_IDS", 0)
    assert rows(lines.line_classes(docs)) == sent and any(x[6] for x in sent)


def test_repeated_lines_are_cut_and_copies_left_whole(spark, none):
    line, long = "a line that many documents share word for word", prose(60).replace("\n", " ")
    data = [(1, f"{line}\nfirst of its own {long}", "s"), (2, f"second of its own {long[:90]}\n\n{line}", "s"), (3, f"{line}\n", "s"), (4, None, "s")]
    out = {r.doc_id: r for r in lines.drop_repeated_lines(table(spark, data), 0.5).collect()}
    assert out[1].text == data[0][1] and out[2].text == data[1][1][: -len(line) - 1] and out[2].n_chars == len(out[2].text)
    assert out[3].text == data[2][1] and out[4].text is None
    every = {r.doc_id: r for r in lines.drop_repeated_lines(table(spark, data)).collect()}
    assert every[3].text == "" and lines.drop_repeated_lines(none).count() == 0


# the pipeline


def test_line_stage_cuts_repeated_lines_that_are_most_of_a_document(spark):
    import corpus_pipeline

    r = random.Random(17)
    shared, own = [" ".join(r.choice(VOCAB) for _ in range(30)) for _ in range(4)], "a short line that no other document has"
    data = [(1, "\n".join(shared), "s"), (2, "\n".join([*shared, own]), "s"), (3, "\n".join(shared), "s")]
    out = {x.doc_id: x.text for x in corpus_pipeline.repeated_lines(spark, table(spark, data), SF).collect()}
    assert out == {1: data[0][1], 2: own}


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = docs.count()
        assert now <= before if k < 4 else now > 0
        before = now
    assert corpus_pipeline.run(spark, SF).count() == before


def poisson(u, mean):
    k, term = 0, np.exp(-mean)
    total = term
    while total <= u and k < mixing.TERMS:
        k += 1
        term = term * mean / k
        total += term
    return k


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(22)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nd", "rt", "s", "ll")]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    boiler, items = [say(9) for _ in range(4)], [say(14) for _ in range(3)]
    texts = ["\n".join([say(40), r.choice(boiler), say(30)]) for _ in range(40)]
    texts += [t.replace(" ", " also ", 1) for t in texts[:6]] + texts[6:9]  # near and exact copies
    texts += [say(60) + "\n" + x + "\n" + say(20) for x in items] + [f"{x} {say(5)}" for x in items]
    texts += ["\n".join(say(20) + " vile abuse" for _ in range(2)) for _ in range(20)]
    data = [(i, t, "en", r.choice("ab"), len(t)) for i, t in enumerate(texts)]
    labels = [(i, 1, int("vile" in t)) for i, t, *_ in data]
    for name, kind, some in (("documents", "doc_id long, text string, lang string, source string, n_chars long", data), ("labels", "doc_id long, quality int, toxic int", labels), ("benchmark", "item_id long, text string", list(enumerate(items)))):
        spark.createDataFrame(some, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = {i: (t, s) for i, t, _, s, _ in data}
    # toxicity, by the model's weights
    w = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    odds = {i: w.get(1 << toxicity.BITS, 0.0) + sum(w.get(x, 0.0) for x in set(toxicity.features(t.encode()).tolist())) for i, (t, _) in docs.items()}
    docs = {i: d for i, d in docs.items() if 1 / (1 + np.exp(-odds[i])) < toxicity.THRESHOLD}
    assert 40 < len(docs) < len(data)
    # lines: the first of each class of lines within the bounds stays
    held = sorted({x for t, _ in docs.values() for x in t.split("\n")})
    bound = lambda n: max([0, *(t for low, t in lines.BOUNDS if n >= low)])
    of = groups(held, [(a, b) for a in held for b in held if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= bound(min(len(a), len(b)))])
    seen, left = set(), {}
    for i in sorted(docs):
        own = []
        for x in docs[i][0].split("\n"):
            if of[x] not in seen:
                seen.add(of[x])
                own.append(x)
        if own:
            left[i] = ("\n".join(own), docs[i][1])
    docs = left
    # near duplicates
    grams = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, (t, _) in docs.items()}
    of = groups(docs, [(a, b) for a in docs for b in docs if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])])
    docs = {i: d for i, d in docs.items() if of[i] == i}
    # decontamination: cut windows out until none is left, drop what is mostly such
    wins = {tuple(x.split()[k : k + 10]) for x in items for k in range(5)}
    clean = {}
    for i, (t, s) in docs.items():
        body, words, gone = t, t.split(), 0
        while hit := {k + j for k in range(len(words) - 9) if tuple(words[k : k + 10]) in wins for j in range(10)}:
            gone += len(hit)
            spans = [m.span() for m in re.finditer(r"[^ \n]+", body)]
            runs = [(a, b) for a in sorted(hit) if a - 1 not in hit for b in [next(k for k in range(a, len(words) + 1) if k not in hit)]]
            for a, b in reversed(runs):
                body = body[: spans[a][0]] + body[spans[b - 1][1] :]
            words = body.split()
        if gone <= decontaminate.COVERAGE * len(t.split()):
            clean[i] = (body, s)
    assert len(clean) < len(docs)
    # mixing: Poisson copies at a uniform number from a digest
    size = {s: sum(x == s for _, x in clean.values()) for s in "ab"}
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    want = []
    for i, (t, s) in clean.items():
        mean = weight[s] / sum(weight.values()) * len(clean) / size[s]
        u = int(hashlib.md5(f"copies7:{i}:1".encode()).hexdigest()[:13], 16) / (1 << 52)
        want += [(i, t, len(t), k) for k in range(poisson(u, mean))]
    got = [(x.doc_id, x.text, x.n_chars, x.replica) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


def test_loops_keep_estimates_small(spark):
    """The size that Spark estimates for a loop's result doesn't grow with its rounds; a path of 600 nodes takes several."""
    links = spark.createDataFrame([(i, i + 1) for i in range(600)], "a long, b long")
    found = common.components(links)
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(601)}
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 1000
