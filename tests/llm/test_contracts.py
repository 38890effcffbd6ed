"""Operators against brute-force versions, on texts with all edge cases."""

import random

import brute
import pytest

from corelode.llm import chat_format, components, decontam, license_scan, quality_rules, sharding, simhash

PLAIN = "the quick brown fox jumps over the lazy dog and runs to the river where it drinks"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [
    None, "", "   \n\t ", "word", "Two Words", PLAIN, PLAIN, PLAIN.upper(), PLAIN + " once more", "é ü ß 漢字 🙂 the MIT License, Apache-License; GNU general\npublic LICENSE x", "a a a a a a a a a a a a a",
    "line one\nline one\n\n  \nline two\nline one", "### | ** <b> $$ % &", "mit license license mit license", "\x0b\x0cx\x1fy\x7fz", LONG, LONG + " tail", "\\### Assistant: </turn> ok",
    "one two three four five six seven eight nine ten eleven", "seven eight nine ten eleven twelve", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0",
]
EXTRA = "n_words long, words string, text_crc32 string, fp string, h int, c0 int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, PLAIN), (5, "another text of the same id"), (None, PLAIN), (None, None)]
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", 2, 3) for i, t in rows], f"doc_id long, text string, {EXTRA}")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(rows, wanted):
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))


def test_quality(docs):
    got = [tuple(r) for r in quality_rules.judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    same(got, [(d, *brute.quality(t)) for d, t in pairs(docs)])


def test_quality_keeps_only_what_passes(docs):
    assert all(not (r["kept"] and r["base_failed"]) for r in quality_rules.judge_quality(docs).collect())
    assert quality_rules.judge_quality(docs).where("kept").count() > 0


def test_quality_plan_is_native(docs):
    plan = quality_rules.judge_quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_licenses(docs):
    got = [tuple(r) for r in license_scan.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    same(got, [(d, *brute.licenses(t)) for d, t in pairs(docs)])
    tagged = license_scan.scan_licenses(docs).where("doc_id = 20").collect()[0]
    assert tagged["labels"] == "apache,exception,gpl,mit" and tagged["score"] == 1.0


@pytest.mark.parametrize(
    ("text", "postfix"),
    [("MIT", ["MIT"]), ("MIT or Apache-2.0 and ISC", ["MIT", "Apache-2.0", "ISC", "and", "or"]), ("(MIT OR ISC) AND GPL-2.0 WITH X", ["MIT", "ISC", "or", "GPL-2.0", "X", "with", "and"]), ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("MIT ISC", None), ("", None), ("OR MIT", None)],
)
def test_expressions(text, postfix):
    assert license_scan.to_postfix(text) == postfix


def test_more_license_evidence_never_lowers_the_score():
    plain = license_scan.scan(b"under the MIT license")
    more = license_scan.scan(b"under the MIT license\nSPDX-License-Identifier: Foo-1.0\n")
    assert plain[6] == more[6] == 0.9 and license_scan.scan(b"SPDX-License-Identifier: MIT\n")[6] == license_scan.scan(b"MIT license\nSPDX-License-Identifier: MIT\n")[6] == 1.0


def test_license_labels_and_scores_equal_brute_force(spark):
    rng = random.Random(12)
    name = lambda: rng.choice(["MIT", "Apache-2.0", "GPL-2.0+", "ISC", "LicenseRef-x", "zlib", "cc-by-4.0"])
    phrases = [*license_scan.BASE_PHRASES, *license_scan.MORE_PHRASES, "no license", "mit", "public license"]

    def expression(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return name() + (f" with {name()}" if rng.random() < 0.3 else "")
        if kind < 0.4:
            return f"({expression(depth - 1)})"
        return f"{expression(depth - 1)} {rng.choice(['AND', 'or', 'and', 'OR'])} {expression(depth - 1)}"

    texts = []
    for i in range(300):
        said = [rng.choice(phrases).title() + rng.choice([".", ",", "\n", " "]) for _ in range(rng.randrange(3))]
        for _ in range(rng.randrange(3)):
            e = expression(3)
            e = e if rng.random() < 0.8 else rng.choice([e + ")", "(" + e, e + " OR", "AND " + e, "", e.replace(" ", " $ ", 1)])
            said.append(rng.choice(["SPDX-License-Identifier: ", "// spdx license identifier : ", "SPDX_License-Identifier="]) + e + rng.choice(["\n", " */\n"]))
        rng.shuffle(said)
        texts.append((i, " ".join(said)))
    for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert (r["labels"], r["score"], r["permissive"]) == brute.license_verdict(dict(texts)[r["doc_id"]]), dict(texts)[r["doc_id"]]


def test_or_takes_any_branch_and_and_takes_all():
    value = lambda e: license_scan.evaluate(e)[1:3]
    assert value("MIT OR GPL-3.0") == (1.0, True) and value("MIT AND GPL-3.0") == (1.0, False) and value("Odd AND MIT") == (0.5, False) and value("Odd OR MIT") == (1.0, True)
    assert value("GPL-2.0 WITH X") == (1.0, False) and value("(GPL-2.0 OR MIT) AND ISC") == (1.0, True)


def test_with_joins_identifiers_only():
    assert license_scan.evaluate("MIT OR ISC WITH X").labels == {"mit", "isc", "exception"}
    assert license_scan.evaluate("(MIT OR ISC) WITH X") is None
    assert license_scan.evaluate("MIT WITH (A WITH B)") is None


def test_sharding(docs):
    for shards in (1, 3, 8):
        rows = sharding.shard_rows(docs, shards).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((d is None, d or 0, len((t or "").encode()) + 1, brute.crc(t)) for d, t in pairs(docs))
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
            assert sharding.locate(r["row_no"], len(rows), shards) == (r["shard"], r["slot"]) and sharding.row_at(r["shard"], r["slot"], len(rows), shards) == r["row_no"]
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(s) for s in by.values()]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(range(n), n, 3)
    assert sorted(p.tolist()) == list(range(n)) and sharding.permute(p, n, 3, back=True).tolist() == list(range(n))


@pytest.mark.parametrize("block_words", [5, 1000])
def test_leaks(spark, docs, block_words):
    items = [(1, "quick brown fox jumps over the lazy dog and runs to the"), (2, "word"), (3, None), (4, ""), (5, "eight nine ten"), (6, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (5, "eight nine ten"), (7, "Two WORDS!"), (8, "a a a a"), (9, "nine ten eleven")]
    table = spark.createDataFrame(items, "item_id long, text string")
    few = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = decontam.find_leaks(few, table, block_words=block_words).collect()
    wanted = brute.leaks(dict(pairs(few)), items)
    for r in rows:
        assert (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"]))) == wanted[r["doc_id"]]
    assert decontam.find_leaks(docs, table).count() == docs.count()


def test_random_leaks(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abc")
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 16)))) for i in range(25)]
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=40)
    wanted = brute.leaks(dict(docs), items)
    for r in found.collect():
        assert (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"]))) == wanted[r["doc_id"]]


def test_leaks_are_cut_out(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    passage = "One, two THREE four five six seven eight nine ten"
    rows = [(1, f"Keep this and these further words here, because all is well. {passage}! And this.", 9, "a"), (2, passage, 9, "b"), (3, "clean", 5, "c"), (4, None, None, "d")]
    got = {r["doc_id"]: r for r in decontam.remove_leaks(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string"), items).collect()}
    assert set(got) == {1, 3, 4} and got[1]["text"] == "Keep this and these further words here, because all is well. ! And this." and got[1]["n_chars"] == len(got[1]["text"]) and got[3]["spans"] == "c"


def test_nothing_is_left_after_the_cut(spark):
    """Cutting one item joins the halves of another."""
    outer, inner = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11".split(), "short item".split()
    items = spark.createDataFrame([(1, " ".join(outer)), (2, " ".join(inner))], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(60))
    rows = [(1, f"{filler} {' '.join(outer[:6])} Short, item; {' '.join(outer[6:])} end"), (2, " ".join([*outer[:5], *inner, *outer[5:], "x y"])), (3, filler)]
    left = decontam.remove_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items)
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert set(got) == {1, 3} and got[3] == filler and got[1].split() == [*filler.split(), "end"]
    assert {r["n_hit"] for r in decontam.find_leaks(left, items).collect()} == {0}


def test_fingerprints_and_components(docs):
    few = docs.where("doc_id is not null")
    got = [tuple(r) for r in simhash.near_duplicates(few).select("doc_id", "fingerprint", "component_id").collect()]
    wanted = brute.components([(d, brute.fingerprint(t)) for d, t in pairs(few)])
    same(got, [(d, f"{f:016x}", c) for d, f, c in wanted])
    assert simhash.near_duplicates(docs).count() == docs.count()


@pytest.mark.parametrize("split_rows", [30, 100_000])
def test_links_of_random_fingerprints(spark, split_rows):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(70):
            f = center
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    hot = rng.getrandbits(64)
    prints |= {hot ^ (1 << a) ^ (1 << b) for a in range(0, 24) for b in range(a)}
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    table = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    got = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in simhash.grouped(table, "doc_id", 3, split_rows).collect()}
    assert got == {f: c for _, f, c in brute.components(rows)}


def test_near_copies(spark):
    rng = random.Random(3)
    base = [[f"v{rng.randrange(5000)}" for _ in range(300)] for _ in range(8)]
    rows, k = [], 100
    for b, words in enumerate(base):
        rows.append((b, " ".join(words)))
        for _ in range(6):
            copy = list(words)
            for _ in range(4):
                copy[rng.randrange(300)] = "changed"
            rows.append((k := k + 1, " ".join(copy)))
    rows += [(500, " ".join(base[0][:100] + base[1][:200])), (0, " ".join(base[0])), (600, None), (601, ""), (None, " ".join(base[2]))]
    for split_rows in (3, 10_000):
        kept = simhash.drop_near_copies(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fp string"), split_rows=split_rows)
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, 0, 1, 3, 4, 5, 6, 7, 500, 600], key=str)


def near_copies(rows, size=5):
    """rows: (id, text), ids different -> ids that stay; every pair is compared."""
    sets, root = {}, {}
    for d, text in rows:
        w = brute.BLANK_WORDS.findall((text or "").translate(brute.LOWER))
        sets[d], root[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set(), d

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(d for d in root if find(d) == d)


def test_near_copies_are_judged_by_jaccard(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(204)]
        rows.append(base)
        for cut in (21, 22, 23, 24, 25, 30, 40):  # similarities from 0.70 to 0.82
            rows.append(base[:-cut] + [word() for _ in range(cut)])
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    for options in ({}, {"block_rows": 3, "split_rows": 5}):
        kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), **options)
        assert sorted(r["doc_id"] for r in kept.collect()) == near_copies(rows)


def test_near_copies_count_shingles_once(spark):
    rng = random.Random(13)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(20):
        line, own = words(24), words(100)
        rows += [(4 * k, " ".join([line] * 10) + " " + words(44)), (4 * k + 1, " ".join([line] * 10) + " " + words(44))]  # different, but for one line
        often = words(5)
        rows += [(4 * k + 2, f"{own} {often}"), (4 * k + 3, f"{own} {' '.join([often] * 10)}")]  # much alike, one line is repeated
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == near_copies(rows) == sorted(i for i in range(80) if i % 4 < 3)


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <turn user> \\ there"), (1, 2, "assistant", "a\\</turn>\n<turn assistant>\nb"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "assistant", "only"),
    (3, 5, None, "x"), (3, 5, None, "x"), (3, 2, "we>ird\nrole", "y"), (None, 1, "user", "z"), (4, 0, "system", "s"),
] + [(5, i, "system" if not i else "assistant" if i % 2 else "user", f"turn {i} " + "word " * (i % 40)) for i in range(300)]


@pytest.mark.parametrize("limits", [{}, {"budget": 200, "system_budget": 20, "history": 60, "history_turns": 3, "block_turns": 16}, {"budget": 50, "system_budget": 10, "history": 0, "history_turns": 0}])
def test_chats(spark, limits):
    df = spark.createDataFrame([(*r, "k", 1) for r in CHATS], "conv_id long, turn long, role string, text string, span string, tokens int")
    windows = chat_format.format_chats(df, **limits)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.chat_digest(windows).collect()}
    assert got == brute.chats(CHATS)
    if limits.get("history_turns"):
        rows = windows.where("conv_id = 5").collect()
        assert len(rows) > 20 and all(r["text"].startswith("<turn system>\nturn 0 ") for r in rows) and any(r["n_repeated"] > 1 for r in rows)
        assert sum(len(r["loss"]) for r in rows) == 150
        over = [r for r in rows if r["tokens"] > limits["budget"]]
        assert all(r["n_new"] == 1 for r in over)


@pytest.mark.parametrize("system", [0, 12, 90, 150, 400])
def test_windows_equal_plain_packing(spark, system):
    rng, budget, system_budget, history, most = random.Random(system), 200, 20, 60, 3
    rows = [(1, 0, "system", "s " * (system - 4))] if system else []
    rows += [(1, t, rng.choice(["user", "assistant"]), "w " * rng.choice([1, 5, 20, 40, 70, 110, 260])) for t in range(1, 80)]
    rows += [(2, t, "user", "") for t in range(9)] + [(None, 3, "assistant", None), (3, None, "user", "x"), (3, None, "user", "x")]
    tokens = lambda text: len((text or "").split()) + 4
    room = max(1, budget - system - max(0, history - max(0, system - system_budget)))
    spans, cost = [], [0 if r[2] == "system" else tokens(r[3]) for r in rows if r[0] == 1]
    for k, c in enumerate(cost):
        if spans and sum(cost[i] for i in spans[-1]) + c <= room:
            spans[-1].append(k)
        else:
            spans.append([k])
    wanted = []
    for span in spans:
        left, used, back = max(0, min(history, budget - system - sum(cost[i] for i in span))), 0, []
        for i in range(span[0] - 1, max(-1, span[0] - 1 - most), -1):
            used += cost[i]
            if used > left:
                break
            back.append(i)
        shown = sorted({*back, *span, *([0] if system else [])})
        wanted.append((len(shown) - len(span), len(span), sum(tokens(rows[i][3]) for i in shown)))
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, system_budget, history, most)
    got = out.where("conv_id = 1").orderBy("block", "span").collect()
    assert [(r["n_repeated"], r["n_new"], r["tokens"]) for r in got] == wanted
    assert all(r["tokens"] <= budget or r["n_new"] - ("turn system" in r["text"] and r["n_repeated"] == 0) <= 1 for r in got)
    digests = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.chat_digest(out).collect()}
    assert digests == brute.chats(rows)


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.chat_digest(chat_format.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("run", [quality_rules.judge_quality, license_scan.scan_licenses, sharding.shard_rows, simhash.near_duplicates, simhash.drop_near_copies])
def test_empty(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).where("n_hit > 0").count() == 0
    assert decontam.remove_leaks(docs.limit(0), none).count() == 0
    assert chat_format.chat_digest(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_components_of_hubs(spark):
    """A hub at the least, one at the greatest and one at a middle node, a chain, loops, repeats and null ends, against union-find."""
    links = [(0, i) for i in range(1, 3000)] + [(9999, i) for i in range(4000, 6000)] + [(6500, i) for i in range(6001, 7000)]
    links += [(i, i + 1) for i in range(8000, 8040)] + [(7, 7), (5, 0), (5, 0), (4100, 9999), (None, 3), (3, None)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    rows = spark.createDataFrame(links, "a long, b long")
    got = components.least_member(rows).collect()
    assert len(got) == len({r["a"] for r in got})
    assert {r["a"]: r["b"] for r in got} == {x: find(x) for x in root if find(x) != x}
