"""Operators 1, 4, 6, 8 and 9 against brute force."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from cases import awkward, bag, frame, prose, words_of
from pyspark.sql import functions as F

from tidemark.llm import decontam, licences, mixing, pieces, quality, secrets

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def doc(k, text):
    return (k, text, *[None] * 7)


# --- licences -------------------------------------------------------------------


def laid_out(paragraphs):
    """As licences usually stand: lines of 70 characters, blank lines between paragraphs."""
    return "\n\n".join("\n".join(re.findall(r".{1,70}(?: |$)", p)) for p in paragraphs)


def test_licences(spark):
    mit = dict((n, t) for n, t in reversed(licences.TEMPLATES))["MIT"]
    rows = [
        doc(1, "Some text.\nReleased under the MIT License.\nMore text follows here today."),
        doc(2, "Header\n\n" + mit.upper().replace(".", ";") + "\n\nOther"),
        doc(3, "Licensed under CC BY-NC 4.0."),
        doc(4, "licensed under cc by 4.0 and so on and on"),
        doc(5, "Nothing of the kind, under no licence at all."),
        doc(6, "intro line\n\n" + re.sub(r"\S+\n", "\n", "\n".join(re.findall(r".{1,70}(?: |$)", mit))) + "\n\nx"),
        doc(7, laid_out(licences._MIT)),
        doc(8, "Copyright\n\n" + laid_out(licences._BSD_3).replace("copyright holder", "author")),
        *[doc(k + 10, r[1]) for k, r in enumerate(awkward())],
    ]

    def normal(t):
        return re.sub(r"[^\w\n]+|_", " ", t.lower())

    def grams(t):
        w = re.split(r"[ \n]+", t.strip(" \n"))
        return set(zip(w, w[1:]))

    templates = [(n, grams(normal(t))) for n, t in licences.TEMPLATES]
    want = []
    for r in rows:
        if r[1] is None:
            continue
        t = normal(r[1])
        units = [("line", k, x) for k, x in enumerate(t.split("\n"))]
        units += [("paragraph", k, x) for k, x in enumerate(re.split(r"\n(?: ?\n)+", t)) if "\n" in x.strip(" \n")]
        for unit, k, x in units:
            own = grams(x)
            scores = [(-2.0 * len(own & g) / (len(own) + len(g)), n) for n, g in templates] if own else []
            if scores and -min(scores)[0] >= licences.LEAST:
                want.append((r[0], unit, k, min(scores)[1], -min(scores)[0]))
    got = bag(licences.licence_matches(frame(spark, rows)).collect())
    assert got == bag(want)
    assert {(r[0], r[3]) for r in got} >= {(1, "MIT"), (2, "MIT"), (3, "CC-BY-NC-4.0"), (7, "MIT"), (8, "BSD-3-Clause")}
    assert sum(r[0] == 7 for r in got) == 3 and sum(r[0] == 8 for r in got) >= 4


# --- token counts -----------------------------------------------------------------


def greedy(vocabulary, word):
    n = at = 0
    while at < len(word):
        size = next(k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary)
        n, at = n + 1, at + size
    return n


def test_automaton_is_greedy():
    rnd = random.Random(1)
    for _ in range(200):
        vocabulary = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 25))}
        tables = pieces.Automaton(vocabulary).tables()
        whole = vocabulary | {bytes([b]) for b in range(256)}
        for _ in range(20):
            word = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 30)))
            assert pieces.count_pieces(tables, word) == greedy(whole, word)


def test_token_counts(spark):
    vocabulary = set(pieces.sentencepiece_pieces(VOCABULARY)) | {bytes([b]) for b in range(256)}
    rows = awkward()
    want = []
    for r in rows:
        data = (r[1] or "").encode()
        n = sum(greedy(vocabulary, pieces.WORD_START + w[:400]) if len(w) <= 400 else -1 for w in data.split())
        want.append((r[0], len(data), len(data.split()), n))
    got = [tuple(r) for r in pieces.token_counts(frame(spark, rows), VOCABULARY).collect()]
    short = [k for k, r in enumerate(rows) if all(len(w) <= 400 for w in (r[1] or "").encode().split())]
    assert bag(g[:3] for g in got) == bag(w[:3] for w in want)
    assert bag(got[k] for k in short) == bag(want[k] for k in short)


# --- quality -----------------------------------------------------------------------


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^ \t-\r]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    ls = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(again)


def test_quality_counts_and_verdicts(spark):
    rows = awkward()
    got = quality.quality_verdicts(frame(spark, rows)).collect()
    assert bag(tuple(r)[:6] for r in got) == bag((r[0], *base_counts(r[1])) for r in rows)
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["posterior"] >= quality.KEEP)
    plan = quality.quality_verdicts(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_documents_stay_and_junk_goes(spark):
    rnd = random.Random(6)
    clean = [doc(k, prose(rnd, 80)) for k in range(150)]
    junk = [doc(1000 + k, " ".join(w + rnd.choice(["***", "$$$"]) for w in prose(rnd, 80).split())) for k in range(15)]
    junk += [doc(2000 + k, " ".join(w.upper() + "!!" for w in prose(rnd, 80).split())) for k in range(15)]
    df = frame(spark, clean + junk)
    kept = {r["doc_id"] for r in quality.keep_quality(df).collect()}
    assert kept == {r[0] for r in clean}
    assert quality.keep_quality(df).schema == df.schema


# --- decontamination ------------------------------------------------------------


def test_decontamination(spark):
    rnd = random.Random(7)
    items = [(k, prose(rnd, n)) for k, n in enumerate([3, 5, 15, 22, 30, 30, 41, 57, 300])]
    items += [(20, items[3][1]), (21, None), (22, ""), (None, prose(rnd, 25))]
    rows = awkward(4)
    for k, (item, text) in enumerate(items):
        if text:
            near = text.split()
            if len(near) > 20:
                near = near[:-1] + ["other"]  # the last word changed
            rows.append(doc(100 + k, prose(rnd, 40) + " " + text.upper() + "!! " + prose(rnd, 40)))
            rows.append(doc(200 + k, prose(rnd, 30) + " " + " ".join(near)))
            if len(near) > 20:  # a whole document that lacks a few of the item's words
                rows.append(doc(300 + k, " ".join(text.split()[:-1])))
                rows.append(doc(400 + k, " ".join(text.split()[2:-1])))
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    bench = {i: split(t) for i, t in items if split(t)}
    df = Counter(s for w in bench.values() for s in sets(w))
    n = len(items)
    weigh = lambda s: sum(math.log1p(n / df[x]) for x in s)

    def similar(window, own):
        return weigh(window & own) / (weigh(own) + len(window - own) * math.log1p(n)) >= 0.8

    want = set()
    for r in rows:
        w = split(r[1])
        for item, iw in bench.items():
            own = sets(iw)
            for p in range(max(1, len(w) - len(iw) + 1) if w else 0):
                if similar(sets(w[p : p + len(iw)]), own):
                    want.add((r[0], item))
                    break
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated_pairs(frame(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    clean = decontam.without_contaminated(frame(spark, rows), benchmark)
    assert clean.schema == frame(spark, rows).schema
    bad = {d for d, _ in want}
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - bad
    assert decontam.contaminated_pairs(frame(spark, rows), benchmark.limit(0)).count() == 0
    assert decontam.contaminated_pairs(frame(spark, []), benchmark).count() == 0


def test_rows_are_equal_for_any_number_of_passes(spark, monkeypatch):
    rnd = random.Random(9)
    shared = prose(rnd, 12)
    items = [(k, prose(rnd, 20) + (" " + shared if k % 2 else "")) for k in range(12)]
    rows = [doc(k, prose(rnd, 10) + " " + t + " " + prose(rnd, 9)) for k, t in items]
    rows += [doc(50 + k, " ".join(t.split()[:-2]) + " new end") for k, t in items]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = bag(decontam.contaminated_pairs(frame(spark, rows), benchmark).collect())
    assert {r[:2] for r in one} >= {(k, k) for k in range(12)} and any(r[2] < 1 for r in one)
    for most in (5, 1):
        monkeypatch.setattr(decontam, "PASS_ITEMS", most)
        assert bag(decontam.contaminated_pairs(frame(spark, rows), benchmark).collect()) == one
    assert decontam.without_contaminated(frame(spark, rows), benchmark).count() == len(rows) - len({r[0] for r in one})


# --- secrets --------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def spell(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secrets(spark):
    rnd = random.Random(11)
    token = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    b64 = string.ascii_letters + string.digits + "+/"
    secret = [token(40, b64) for _ in range(6)] + [token(24, b64) for _ in range(6)]
    texts = [
        'password = "hunter2hunter2" and TOKEN: abc', "token=secret: abcdefgh12", "api_key:'x' secret=" + "q" * 9,
        "AKIA" + "ABCDEFGH12345678 AKIAX", "é文 " + "0123456789abcdef" * 3 + " \U0001f600 Passwd :  longenough.value",
        "deadbeef" * 4 + "deadbeef" * 3, "4" * 40, "ThisIsAVeryLongIdentifierNameInCamelCase1",
        "the-quick-brown-fox-jumps-over-the-lazy-dog-2024", " ".join("secret=abcdefgh%d" % k for k in range(600)),
        "THEQUICKBROWNFOXJUMPSOVERTHELAZYDOGAGAIN", "abcabcabcabcabcabcabcabcABC123",
    ]
    rows = [doc(1000 + k, prose(rnd, 20) + " " + s + " " + prose(rnd, 20)) for k, s in enumerate(secret)]
    rows += [doc(100 + k, t) for k, t in enumerate(texts)] + [(r[0], *r[1:]) for r in awkward()]
    got = secrets.secret_digest(frame(spark, rows)).collect()
    want = []
    for r in rows:
        spans = base_spans(r[1])
        kinds = Counter(k for _, k, _ in spans)
        want.append((r[0], kinds[0], kinds[1], kinds[2], hashlib.sha256(spell(spans).encode()).hexdigest()))
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    for r in got:
        texts_of = [x[1] or "" for x in rows if x[0] == r["doc_id"]]
        assert any(set(filter(None, spell(base_spans(t)).split(","))) <= set(r["spans"].split(",")) for t in texts_of)
    random_of = {r["doc_id"]: r["n_random"] for r in got}
    found = [k for k in range(12) if random_of[1000 + k]]
    assert len(found) >= 11
    assert not any(random_of[100 + k] for k in range(len(texts)))
    assert secrets.secret_spans(frame(spark, [])).count() == 0


# --- mixing ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "options", [{}, {"target_entropy": 1.0, "max_passes": None}, {"target_entropy": 1.0, "max_passes": 1.5}, {"budget": 50}]
)
def test_mixing(spark, options):
    rnd = random.Random(12)
    rows = awkward() + [(500 + k, prose(rnd, 30), None, rnd.choice(["s0", "s3"]), 1, None, None, None, None) for k in range(80)]
    size = Counter()
    for r in rows:
        size[r[3]] += len(words_of(r[1]))
    total = options.get("budget", sum(size.values()))
    df = frame(spark, rows)
    got = mixing.mix_sources(df, **options).collect()
    used, weight, passes = Counter(), {}, {}
    for r in got:
        used[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
        passes.setdefault((r["doc_id"], r["n_tokens"], r["source"]), []).append(r["pass"])
    largest = max(len(words_of(r[1])) for r in rows)
    assert sum(weight.values()) == pytest.approx(1)
    for s in weight:
        # a repeated row shares its place in the order
        assert weight[s] * total - 1e-6 <= used[s] < weight[s] * total + 2 * largest
    if "max_passes" in options and options["max_passes"]:
        assert max(weight[s] * total / size[s] for s in weight) <= options["max_passes"] + 1e-4
    elif options.get("target_entropy") == 1.0:
        assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(math.log(len(weight)), abs=1e-4)
    for (d, _, _), p in passes.items():  # whole passes before the partial one
        copies = sum(r[0] == d for r in rows)
        assert copies > 1 or sorted(p) == list(range(len(p)))
    wide = mixing.mix_sources(df, keep_columns=True, **options)
    assert wide.columns == [*df.columns, "n_tokens", "weight", "pass", "position"]
    assert bag((r["doc_id"], r["pass"], r["position"]) for r in wide.collect()) == bag((r["doc_id"], r["pass"], r["position"]) for r in got)


def test_results_replace_columns_of_their_names(spark):
    rows = [(k, "a b c", "s", -1.0, -1, "p") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double, n_tokens int, Position string")
    got = mixing.mix_sources(df, keep_columns=True)
    assert got.columns == ["doc_id", "text", "source", "n_tokens", "weight", "pass", "position"]
    assert [(r["n_tokens"], r["weight"], r["pass"]) for r in got.collect()] == [(3, 1.0, 0)] * 4


def test_mixing_an_empty_table(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mix_sources(frame(spark, [doc(1, None), doc(2, " ")])).count() == 0


def test_position_orders_differ_between_passes(spark):
    rows = [(k, "a b c", None, "one", 1, None, None, None, None) for k in range(50)]
    got = mixing.mix_sources(frame(spark, rows), budget=300).collect()
    order = {p: [r["doc_id"] for r in sorted(got, key=lambda r: r["position"]) if r["pass"] == p] for p in (0, 1)}
    assert sorted(order[0]) == sorted(order[1]) == list(range(50)) and order[0] != order[1]


def test_empty_scans(spark):
    df = frame(spark, [])
    assert licences.licence_matches(df).count() == 0
    assert pieces.token_counts(df, VOCABULARY).count() == 0
    assert quality.quality_verdicts(df).count() == 0
    assert quality.keep_quality(df).count() == 0
    assert df.select(F.col("doc_id")).count() == 0
