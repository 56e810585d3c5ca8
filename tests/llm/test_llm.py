"""Training-data operators: brute force, round trips and edge cases."""

import base64
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from turnstone.llm import conversation, neardup, pack, pii, residue, split, tokenize
from turnstone.session import Scratch

# --- 1 splitting


def test_split_keeps_everything(spark):
    texts = {
        1: "a😀" * 9000, 2: "x" * 9000, 3: "word " * 4000, 4: ("Sentence one here. " * 30 + "\n") * 40, 5: ("para line\n" * 50 + "\n") * 40,
        6: "é́" * 9000, 7: "short", 8: None, 9: "", 10: "x" * 8000, 11: "x" * 8001, 12: "l\r\n" * 9000,
    }
    df = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "id long, content string, text string")
    got = split.split_oversized(df).orderBy("id", "piece").collect()
    assert {r.id for r in got} == {k for k, v in texts.items() if v and len(v) > 8000}
    for k in {r.id for r in got}:
        p = [r for r in got if r.id == k]
        assert "".join(r.text[r.overlap :] for r in p) == texts[k]
        assert all(len(r.text) <= 8000 for r in p)
        assert all(b.overlap == 200 and b.text[:200] == a.text[-200:] for a, b in itertools.pairwise(p))
    assert all(r.text.endswith("\n\n") for r in got if r.id == 5)
    assert split.split_oversized(df.where("false")).count() == 0


# --- 2 conversations


def test_pointers(spark):
    rows = [("t", 1, None), ("t", 2, 1), ("t", 3, 2), ("t", 4, 2), ("t", 5, 99), ("t", 6, 5), ("t", 7, 8), ("t", 8, 7), ("t", 9, 8), ("t", 10, 10)]
    rows += [("u", i, i - 1 if i else None) for i in range(40)]
    got = conversation.resolve(spark.createDataFrame(rows, "session_id string, node long, parent long"), Scratch(spark, "t")).collect()
    out = {(r.session_id, r.node): (r.root, r.depth, r.status) for r in got}
    assert len(got) == len(rows)
    assert out["t", 4] == (1, 2, "ok") and out["t", 6] == (5, 1, "orphan") and out["t", 5] == (5, 0, "orphan")
    assert all(out["t", n][2] == "cycle" for n in (7, 8, 9, 10))
    assert all(out["u", i] == (0, i, "ok") for i in range(40))


def entry(spark, rows):
    return spark.createDataFrame(
        [(s, o, k, t, m, c, r) for s, o, k, t, m, c, r in rows], "session_id string, byte_offset long, type string, timestamp string, is_meta boolean, content string, received_at string"
    ).withColumn("received_at", F.to_timestamp("received_at"))


def test_sessions(spark):
    said = '[{"type": "text", "text": "yes"}]'
    rows = []

    def add(s, *lines):
        rows.extend((s, i * 10, k, t, False, c, "2025-01-01") for i, (k, t, c) in enumerate(lines))

    t = [f"2025-01-01T00:00:0{i}Z" for i in range(9)]
    add("good", ("user", t[0], "q"), (" Assistant ", t[1], said), ("user", "2025-01-01T02:00:02+02:00", "[1] q"), ("assistant", None, said))
    add("late", ("assistant", t[5], said), ("user", t[1], "q"))
    add("blank", ("user", t[0], " 　\n"), ("system", t[1], "x"))
    add("open", ("user", t[0], "q"), ("assistant", t[1], said), ("user", t[2], "q"))
    add("twice", ("user", t[0], "q"), ("user", t[1], "q"), ("assistant", t[2], said))
    add("first", ("assistant", t[0], said), ("user", t[1], "q"), ("assistant", t[2], said))
    add("null", ("user", t[0], "q"), ("assistant", t[1], None), ("assistant", t[2], said))
    add("cut", ("user", t[0], "q"), ("assistant", t[1], said), ("assistant", t[2], '[{"type": "te'))
    add("string", ("user", t[0], "q"), ("assistant", t[1], "a plain string"))
    rows.append(("good", 0, "user", t[0], False, "q", "2025-01-02"))
    rows.append((None, 0, "user", t[0], False, "q", "2025-01-02"))
    lines, placed = conversation.paths(entry(spark, rows), Scratch(spark, "t"))
    got = {r.session_id: r.reason for r in conversation.judge(lines, placed).collect()}
    assert got == {"blank": "empty", "open": "unanswered", "twice": "unanswered", "first": "broken", "null": "broken", "cut": "broken", "string": "unanswered"}
    text = conversation.conversations(entry(spark, rows), Scratch(spark, "t")).where("session_id = 'good'").orderBy("position").collect()
    assert [(r.role, r.text) for r in text] == [("user", "q"), ("assistant", "yes"), ("user", "[1] q"), ("assistant", "yes")]
    lines, placed = conversation.paths(entry(spark, rows).where("false"), Scratch(spark, "t"))
    assert conversation.judge(lines, placed).count() == 0


# --- 3 near duplicates


def similar(texts, t=0.7):
    sets = {}
    for i, c in texts.items():
        w = re.findall("[a-z0-9]+", (c or "").lower())
        if len(w) >= 30:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize(("limit", "small"), [(2000, 8), (2000, 1), (4, 1)])
def test_near_duplicates(spark, limit, small):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for family in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([31, 60, 400]))]
        for k in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 15))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts[family * 10 + k] = " ".join(w)
        texts[family * 10 + 7] = texts[family * 10].upper()
    texts |= {900: None, 901: "", 902: "too short", 903: "a " * 40, 904: "A, " * 50}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(0, texts[0], 1)], "id long, content string, cls int")
    members, pairs = neardup.similar_sets(df, Scratch(spark, "t"), limit=limit, small=small)
    got = {(x.id_a, x.id_b) for x in neardup.id_pairs(members, pairs).collect()}
    assert got == similar(texts)
    groups = {x.id: x.group_id for x in neardup.groups(members, pairs, Scratch(spark, "t")).collect()}
    assert all(groups[a] == groups[b] for a, b in got)


def test_sketches_never_exceed_the_difference():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (5, 100, 1000):
        a, b = (np.unique(r.integers(0, 1 << 40, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: n // 2], b]))
        x, y = neardup.sketch(a), neardup.sketch(b)
        size = min(len(x), len(y))
        d = int(np.bitwise_count(neardup.fold(x, size) ^ neardup.fold(y, size)).sum())
        assert d <= len(np.setxor1d(a, b))
        assert (neardup.unpack_runs(neardup.pack_runs(a)) == a).all()


def test_tree_prunes_and_loses_nothing():
    import numpy as np

    r = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = np.unique(r.integers(0, 1 << 40, 150).astype(np.uint64))
        sets += [np.unique(np.concatenate([base[k:], r.integers(0, 1 << 40, k).astype(np.uint64)])) for k in range(0, 40, 4)]
    sk, n = [neardup.sketch(s) for s in sets], [len(s) for s in sets]
    near = {(min(p), max(p)) for p in neardup.tree_pairs(sk, n, 0.7)}
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.7 * len(np.union1d(sets[i], sets[j]))}
    assert true <= near and len(near) < 3 * len(true)


@pytest.mark.parametrize("rounds", [1, 2, 16])
def test_division_loses_nothing(spark, rounds):
    import numpy as np

    r = np.random.default_rng(4)
    sets = []
    for _ in range(20):
        base = np.unique(r.integers(0, 1 << 40, 150).astype(np.uint64))
        sets += [np.unique(np.concatenate([base[k:], r.integers(0, 1 << 40, k).astype(np.uint64)])) for k in range(5)]
    points = spark.createDataFrame([(i, len(s), bytearray(neardup.sketch(s))) for i, s in enumerate(sets)], "cls long, n int, sketch binary")
    parts = neardup.divide(points.selectExpr("7L as shard", "cls"), points, Scratch(spark, "t"), 60, 0.97, rounds).distinct().collect()
    together = {}
    for x in parts:
        together.setdefault(x.shard, []).append(x.cls)
    got = {p for members in together.values() for p in itertools.combinations(sorted(members), 2)}
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.97 * len(np.union1d(sets[i], sets[j]))}
    assert true and true <= got


# --- 4 personal details


def test_personal(spark):
    r = random.Random(5)
    given, family = [f"Gi{a}lo" for a in "bcdfghklmn"], [f"Fa{a}sen" for a in "bcdfghklmn"]
    rows, want = [], set()
    for i in range(60):
        n, p, e = f"{r.choice(given)} {r.choice(family)}", r.choice(["+44 20 7946 0123", "(209) 555-0112", "2465550140"]), f"x.y{i}@mail.example.org"
        rows.append((i, f"My name is {n}, I took over a/b.py. You can reach me on {p} if it fails. Send it to <{e}>. The epoch value 1716342985 in x is odd. The Delta Watcher stopped."))
        want |= {(i, "name", n), (i, "phone", p), (i, "email", e)}
    rows += [(100, "The office is Flat 10, 112 Winder Street, Town. Passport no.: L8176633 and joe at corp dot example dot com wrote to git@merge.line:a/b.git"), (101, None), (102, "")]
    want |= {(100, "address", "Flat 10, 112 Winder Street"), (100, "id_number", "L8176633"), (100, "email", "joe at corp dot example dot com")}
    texts = spark.createDataFrame(rows + rows[:3], "id long, content string")
    names = spark.createDataFrame([(x, "given") for x in given[:7]] + [(x, "family") for x in family[:7]], "name_part string, part_kind string")
    found = Scratch(spark, "t").save(pii.find_personal(texts, names, Scratch(spark, "t")), "d")
    assert {(x.id, x.kind, x.found) for x in found.collect()} == want
    out = {x.id: x.content for x in pii.redact(texts.distinct(), found).collect()}
    assert out[0].startswith("My name is [NAME], I took over a/b.py. You can reach me on [PHONE] if") and out[101] is None and out[102] == ""
    assert "[ADDRESS], Town" in out[100] and "git@merge.line" in out[100]


def test_numbers_known_elsewhere(spark):
    rows = [
        (1, "You can call +44 20 7946 0123 or read it."), (2, "Reach me on 020 7946 0555 if it fails."), (3, "Reach me on +1 209 555 0112 if it fails."), (4, "Reach me on +1 209 555 0113 if it fails."),
        (5, "Old sheet row zeta 020 7946 0555 gamma tail."), (6, "Passport 123-45-6789 is mine. SSN 123-45-6789"), (7, "Blue line beta 123-45-6789 ends there."), (8, "Sum of parts 7731-4420-991 differs."),
    ]
    texts = spark.createDataFrame(rows, "id long, content string")
    names = spark.createDataFrame([], "name_part string, part_kind string")
    found = {(x.id, x.kind, x.found) for x in pii.find_personal(texts, names, Scratch(spark, "t")).collect()}
    assert {(2, "phone", "020 7946 0555"), (5, "phone", "020 7946 0555"), (7, "id_number", "123-45-6789")} <= found
    assert not [x for x in found if x[0] == 8]


def test_names_hosts_and_streets_are_pooled(spark):
    rows = [(i, f"Ask Gi{c}lo Fa{c}sen about the port before it closes.") for i, c in enumerate("bcdfghklmn" * 3)]
    rows += [(100 + i, f"The Delta Page and the Page Indexer both call part_{i}.") for i in range(30)]
    rows += [(200, "Ask Page Indexer about the port before it closes."), (201, "Ask Xiblo Yabsen about the port before it closes.")]
    rows += [(300, "We meet at Flat 2, 12 Winder Street today."), (301, "Odd words stand by 14 Winder Street here."), (302, "Mail joe@corp.example.org now."), (303, "Odd signs by ann [at] corp.example.org there.")]
    names = [(f"Gi{c}lo", "given") for c in "bcdfghklmn"] + [(f"Fa{c}sen", "family") for c in "bcdfghklmn"]
    texts, listed = spark.createDataFrame(rows, "id long, content string"), spark.createDataFrame(names, "name_part string, part_kind string")
    got = {(x.id, x.kind, x.found) for x in pii.find_personal(texts, listed, Scratch(spark, "t")).collect()}
    assert (201, "name", "Xiblo Yabsen") in got and not [x for x in got if "Indexer" in x[2]]
    assert {(301, "address", "14 Winder Street"), (303, "email", "ann [at] corp.example.org")} <= got


def test_long_addresses_are_whole():
    long = "a" * 60 + "@" + "b" * 60 + "." + "c" * 60 + "." + "d" * 60 + ".example.org"
    assert [x[3] for x in pii.candidates(f"Write to {long} today")] == [long]


def test_numbers_in_a_row():
    ids = [f"{123 + k}-45-{6789 - k}" for k in range(9)]
    for sep in (" ", "  ", ", "):
        assert {x[3] for x in pii.candidates("SSN " + sep.join(ids) + " end") if x[0] == "id_number"} >= set(ids)
    assert not [x for x in pii.candidates("x " + "1" * 40 + " y") if x[0] in pii.NUMBERS]


# --- 6 encoding

EDGES = ["", "  ", "a  b", "it's we'll I'M ''s 's 's' \n's x'red 'relax don't", "　　日本 語", "1st ²½ ⅷ", "a\n\n\nb", "trailing   ", "é́x", "'", "\r\n\r\n  y", "\x85a \x1cb", "😀" * 9, "a" * 700 + "b" * 900, "日本" * 700]


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenize.vocabulary_path(), "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_encoding(spark, monkeypatch):
    r, own = random.Random(1), reference()
    noise = ["".join(r.choice("ab 1'\n.é語 \tsé") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts = dict(enumerate([*EDGES, *noise, None]))
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, ids string")
    got = {x.doc_id: x for x in tokenize.encode_documents(df, offsets=True).collect()}
    for k, v in texts.items():
        assert got[k].ids == own.encode_ordinary(v or ""), v
        assert tokenize.decode(got[k].ids, tokenize.vocabulary_path()) == (v or "")
        assert len(got[k].offsets) == len(got[k].ids)
    assert {x.doc_id: x.n_tokens for x in tokenize.count_tokens(df).collect()} == {k: len(x.ids) for k, x in got.items()}
    enc = tokenize.Encoder(tokenize.vocabulary_path())
    monkeypatch.setattr(tokenize, "_PASS", 64)
    long = "some words 12 in a long text's row " * 30
    assert sum((x[2].tolist() for x in enc.encode([long])), []) == own.encode_ordinary(long)


def test_contraction_at_the_end_of_a_pass(monkeypatch):
    own, enc = reference(), tokenize.Encoder(tokenize.vocabulary_path())
    for text in ("don't", "it's", "I'm", "he'd", "we'll", "x'", "a's b's"):
        for batch in ([text], ["first text", text], [text, ""]):
            got = list(enc.encode(batch))
            assert sum((x[2].tolist() for x in got), []) == sum((own.encode_ordinary(t) for t in batch), [])
    monkeypatch.setattr(tokenize, "_PASS", 64)
    long = "abc it's " * 40
    assert sum((x[2].tolist() for x in enc.encode([long])), []) == own.encode_ordinary(long)


# --- 7 packing


def test_packing(spark):
    r = random.Random(2)
    sizes = [r.choice([1, 2048, 2049, 9000]) if i % 50 == 0 else int(r.lognormvariate(5, 1.2)) + 1 for i in range(3000)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(9001, 0, ""), (9002, None, "")], "doc_id long, n_tokens long, bin string")
    got = pack.pack(df, Scratch(spark, "t"), group=800).collect()
    by, bins = {}, {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
        bins.setdefault(x.bin, []).append(x)
    assert set(by) == set(range(3000))
    for k, ps in by.items():
        assert sum(p.n_tokens for p in ps) == sizes[k] and len(ps) == -(-sizes[k] // 2048)
        assert [p.first_token for p in sorted(ps, key=lambda p: p.piece)] == [2048 * i for i in range(len(ps))]
    assert all(sum(p.n_tokens for p in ps) <= ps[0].bin_capacity <= 2048 and len({p.bin_capacity for p in ps}) == 1 for ps in bins.values())
    assert sum(sizes) >= 0.97 * 2048 * len(bins)
    assert pack.pack(df.where("false"), Scratch(spark, "t")).count() == 0


# --- 8 residue

CASES = {
    "Please enable JavaScript to view this page.": "script", "Home | Search\n\n404 Not Found\n\nThe page you asked for does not exist on this server.": "error",
    "# Title\n\nText folgt.": "filler", "Dear {{user_name}}, your order is ready.": "placeholder", "| owner | [[Name of reviewer]] |": "placeholder", "# %(author)s\n\nReal text follows here.": "placeholder",
    "502 Bad Gateway\nedgeproxy/1.2.3": "error", "Lorem ipsum dolor sit amet magna aliqua.": "filler",
}
KEPT = [
    None, "", " ", "ok", 'The crawler stored "Please enable JavaScript" for 5 pages.', "The template writes `{{name}}` when the value is empty.", "```yaml\nimage: {{ .Values.x }}\nroot: ${USER_NAME}\n```\nThe chart renders now.",
    "User: The viewer answers 404 Not Found for a.py.\n\nAssistant: The route was missing, I added it to the table and to the tests.", "We replaced the lorem ipsum text in the fixture with real data.",
    "2024-01-01T00:00:00Z ERROR 503 Service Unavailable", "Map<Context, List<Line>> replaced cursor[13].",
]


def test_residue(spark):
    rows = [(i, t, "x") for i, t in enumerate([*CASES, *KEPT])]
    df = spark.createDataFrame(rows, "doc_id long, text string, reason string")
    found = {x.doc_id: x.reason for x in residue.find_residue(df).collect()}
    assert found == dict(enumerate(CASES.values()))
    assert residue.without_residue(df).count() == len(KEPT)


def test_residue_of_any_length():
    assert residue.verdict("Please enable JavaScript to view this page. " * 120) == "script"
    assert residue.verdict("Dolor sit magna aliqua amet.\n" * 60) == "filler"
    assert residue.verdict("The parameter of the index is read once and kept. " * 120) == ""
    assert residue.verdict("The parameter of the index is read once and kept.\n" * 60) == ""


#: Wordings chosen after the stems were fixed; none was used to choose stems.
HELD_OUT = [
    "Sorry, the page you were looking for could not be found.", "Our server ran into an unexpected problem. Try reloading the page.", "You must be signed in to see this document.",
    "It looks like JavaScript is switched off. Kindly activate it and reload the page.", "Your connection was reset while the page was loading.", "We could not find the file you requested.",
    "The database is temporarily offline. Please come back in a few minutes.", "HTTP 401: authentication is required to open this resource.", "Request blocked by the administrator of this network.",
    "Bitte schalten Sie JavaScript in Ihrem Browser ein, diese Seite benötigt es.", "Votre session a expiré, veuillez vous connecter de nouveau.", "Esta página ya no existe. Volver al inicio.",
    "该页面暂时无法访问，请稍后再试。", "セッションの有効期限が切れました。もう一度ログインしてください。", "The text for this chapter will follow soon.", "Description to be added.",
    "Der Inhalt dieser Seite folgt in Kürze.", "Insert your summary text here.", "The host did not respond: connection timed out.", "This document was deleted or you do not have permission to view it.",
    "Cookies are disabled. You need to allow cookies and scripts to continue.", "The link you followed has expired.", "Too many login attempts. Please try again in 15 minutes.", "Sit amet dolor in magna quis ipsum nulla velit.",
]
HELD_OUT_KEPT = [
    "The login page now shows the right title because the template was fixed.","We changed the timeout of the session cache from 5 to 10 seconds in the watcher.","JavaScript files are bundled by the build and copied to the assets folder of the release.",
    "The error page was redesigned by the web team and now lists the three newest transcripts.","I enabled cookies in the proxy and measured the latency of the search again.","The request failed because the index was rebuilt at the same time; the second run was fine and the numbers match.",
    "Maintenance of the old parser costs us a day per week, so I suggest to drop it.","The section on retention was moved to the guide, and the summary lists its columns.",
]


def test_residue_in_other_words():
    assert sum(residue.verdict(t) != "" for t in HELD_OUT) >= 0.9 * len(HELD_OUT)
    assert not [t for t in HELD_OUT_KEPT if residue.verdict(t)]


def test_residue_with_numbers_and_data():
    assert residue.verdict("Error 503: Service Temporarily Unavailable. Please try again in a few minutes.") == "error"
    assert residue.verdict("Access denied. Your request was blocked (035540d).") == "error"
    assert residue.verdict('Menu\n\n{"error": {"code": 429, "message": "Too many requests, slow down"}}') == "error"
    assert residue.verdict("2024-01-01T00:00:00Z ERROR [a-b] c_d: access denied") == ""
    assert residue.verdict("ERROR [queue-worker] request denied, try again later") == ""
    assert residue.verdict("x" * 5000 + " the page was not found") == ""
    assert residue.verdict("Sorry, the page you want could not be found. " * 2000) == "error"
