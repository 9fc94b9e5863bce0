"""Conversation repair, decontamination and fill-in-the-middle against brute force and SQL."""

import functools
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from askgrid.llm import conversation_repair as repair
from askgrid.llm import decontaminate, fill_middle, queries
from check import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_decontamination",
                                  "op13_fill_middle"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    result = con.execute(queries.SQL[name])
    want = rows_of([c[0] for c in result.description], result.fetchall())
    got = queries.QUERIES[name](spark, FOLDER)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want


# --- conversation repair ------------------------------------------------------------------------

def best_repair(rows):
    """Cost and letters of rows ``(role, must go, cut)`` by trying every edit."""

    @functools.cache
    def best(i, state):
        ways = []
        if i == len(rows) and state in "ea":
            ways.append((0, ""))
        then = {"e": "u", "s": "u", "u": "a", "a": "u"}[state]
        # An insertion right after another one never pays.
        if i < len(rows):
            ways += [(c, letters) for c, letters in [step(i, state)] if c is not None]
            c, letters = step(i, then)
            if c is not None:
                ways.append((c + 2, "I" + letters))
        elif then in "ea":
            ways.append((2, "I"))
        elif state == "s":
            ways.append((4, "II"))
        return min(ways) if ways else (None, "")

    @functools.cache
    def step(i, state):
        role, gone, cut = rows[i]
        then = {"e": "u", "s": "u", "u": "a", "a": "u"}[state]
        moves = [("D", 3, state)]
        if not gone:
            if role[:1] == then:
                moves.append(("K", int(cut), then))
            if role[:1] == "s" and state == "e":
                moves.append(("K", int(cut), "s"))
            moves.append(("R", 2 + int(cut), then))
        ways = []
        for letter, cost, to in moves:
            c, letters = best(i + 1, to)
            if c is not None:
                ways.append((c + cost, letter + letters))
        return min(ways) if ways else (None, "")

    for i in range(len(rows), 0, -1):  # from the end, so that recursion stays flat
        for state in "esua":
            best(i, state)
    return best(0, "e")


def lines(rows, letters):
    """The repaired lines of rows ``(role, text)``."""
    out, at, state = [], 0, "e"
    for letter in letters:
        then = {"e": "u", "s": "u", "u": "a", "a": "u"}[state]
        named = {"u": "user", "a": "assistant"}[then]
        if letter == "I":
            out.append(f"{named}:")
            state = then
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            out.append(f"{role}:{text}")
            state = "s" if role[:1] == "s" else then
        elif letter == "R":
            out.append(f"{named}:{text}")
            state = then
    return out


def report_of(rows):
    """The report of one conversation's rows ``(turn, role, text)``."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                 hashlib.sha256(r[2].encode()).digest()))
    seen, marks, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        blank, copy, cut = not bare, (role, text) in seen, bare[-1:] not in (".", "!", "?")
        seen.add((role, text))
        kind = "blank" if blank else "duplicate" if copy else "truncated" if cut else None
        if kind:
            counts[kind] += 1
        marks.append((role, blank or copy, cut))
    turns = {t for t, *_ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    cost, letters = best_repair(marks)
    text = "\n".join(lines([(r, x) for _, r, x in rows], letters))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"],
            counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, letters, hashlib.sha256(text.encode()).hexdigest())


def test_symbols_equal_brute_force():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool"]
    for _ in range(400):
        rows = [(rng.choice(roles), rng.random() < 0.15, rng.random() < 0.3)
                for _ in range(rng.randrange(9))]
        if rng.random() < 0.4:  # long runs of one symbol
            rows = [r for r in rows for _ in range(rng.choice([1, 1, 5, 9]))]
        signs = bytes(0 if gone else repair.symbol(roles.index(role), cut)
                      for role, gone, cut in rows)
        assert repair.repair_symbols(signs) == best_repair(tuple(rows)), rows


def test_powers_equal_steps():
    for sign in range(9):
        step = np.array(repair.power(sign, 0))
        matrix = step
        for length in range(1, 20):
            assert (repair.run_matrix(sign, length) == matrix).all()
            assert repair.run_before(sign, length, repair.END) == repair._before(
                tuple(map(tuple, matrix.tolist())), repair.END)
            matrix = repair.times(matrix, step)
    # Assistant rows alone: a user row before each, or every other one changed into it.
    many = bytes([repair.symbol(1, False)] * 5000)
    assert repair.repair_symbols(many) == (5000, "RK" * 2500)


def conversations(rng, many):
    texts = ["Yes.", "No!", "so on", "", " \n", "Why?", None, "é. ", "a. "]
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None]
    rows = []
    for conv in [*range(many), None]:
        for turn in range(rng.randrange(1, 8)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, rng.choice([turn, turn, None, turn + 3]), rng.choice(roles),
                             rng.choice(texts)))
    long = [(777, t, rng.choice(roles[:5]), rng.choice(texts[:6]) + f"{rng.randrange(40)}.")
            for t in range(500)]
    return [*rows, *long, *rows[:5], (888, -5, "user", "x" * 300_000 + ".")]


@pytest.mark.parametrize("hot_rows", [10, repair.HOT_ROWS])
def test_reports_equal_brute_force(spark, hot_rows):
    data = conversations(random.Random(11), 40)
    frame = spark.createDataFrame([(*r, 1, "z") for r in data],
                                  "conv_id int, turn bigint, role string, text string, "
                                  "block int, key string")
    ids = [*[r[0] for r in data], 999]
    every = spark.createDataFrame([(i,) for i in ids], "conv_id int")
    plan = repair.plan_repairs(frame, hot_rows=hot_rows)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(plan, every).collect()}
    want = {i: report_of([r[1:] for r in data if r[0] == i]) for i in set(ids)}
    assert got == want
    edits = plan.repaired().where("key = '=777'").orderBy("block", "place").collect()
    assert "".join(r.edit for r in edits) == got[777][6]
    text = "\n".join(f"{r.role}:{r.text}" for r in edits if r.role is not None)
    assert hashlib.sha256(text.encode()).hexdigest() == got[777][7]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    plan = repair.plan_repairs(none)
    assert repair.repair_report(plan, none).count() == 0 and plan.repaired().count() == 0


# --- decontamination ------------------------------------------------------------------------------

def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end())
            for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]


def leaks_of(text, items, width=10):
    found = plain_words(text)
    words, hit, owners = [w for w, *_ in found], set(), set()
    for item, of in items:
        own = [w for w, *_ in plain_words(of)]
        size = min(width, len(own))
        frames = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else ()
        for i in range(len(words)):
            if frames and tuple(words[i:i + size]) in frames:
                hit.update(range(i, i + size))
                owners.add("" if item is None else str(item))
    runs = [i for i in sorted(hit) if i - 1 not in hit]
    ends = [i for i in sorted(hit) if i + 1 not in hit]
    return (len(words), len(hit), sorted(owners),
            [(a, b, found[a][1], found[b][2]) for a, b in zip(runs, ends)])


@pytest.mark.parametrize("most_words", [decontaminate.MOST_WORDS, 30])
def test_leaks_equal_brute_force(spark, most_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    rng = random.Random(2)
    vocabulary = ["a", "b", "Été", "x1", "漢字", "the", "É"]

    def passage(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", " \x00"])
                       for _ in range(n))

    items = [(i, passage(rng.choice([3, 9, 10, 12, 40]))) for i in range(12)]
    items += [(3, "A, b; É"), (50, None), (None, passage(14)), (51, "?!"), (7, items[7][1])]
    texts = [None, "", "?!", "the", items[8][1].upper(), "zz " + items[2][1] + " zz"]
    for _ in range(40):
        text = passage(rng.randrange(60))
        if rng.random() < 0.6:
            text += "Zebra " + rng.choice([t for _, t in items if t]) + " zebra" * rng.randrange(2)
        texts.append(text)
    texts.append(passage(20_000) + items[4][1])
    docs = [(i if i != 9 else None, t) for i, t in enumerate([*texts, texts[10]])]
    docs[-1] = (10, texts[10])
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs],
                                  "doc_id bigint, text string, key string, items int")
    bench = spark.createDataFrame([(*i, "x") for i in items],
                                  "item_id bigint, text string, words string")
    found = decontaminate.find_contamination(frame, bench, most_words=most_words)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), [tuple(p) for p in r.passages])
           for r in found.collect()]
    want = [(i, *leaks_of(t, items)) for i, t in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontaminate.find_contamination(frame.limit(0), bench, most_words=most_words).count() == 0
    nothing = decontaminate.find_contamination(frame, bench.limit(0), most_words=most_words)
    assert nothing.where("n_hit > 0 or size(items) > 0").count() == 0
    assert nothing.count() == len(docs)


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "é one two three four!"), (2, None)],
                                  "doc_id int, text string")
    bench = spark.createDataFrame([(1, "two, THREE")], "item_id int, text string")
    found = decontaminate.find_contamination(frame, bench)
    joined = frame.join(found, "doc_id").select("doc_id", decontaminate.redact(
        frame["text"], found["passages"], "[x]").alias("t"))
    assert dict(joined.collect()) == {1: "é one [x] four!", 2: None}


# --- fill in the middle ---------------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def test_rank_index_is_exact_within_its_bound():
    rng = random.Random(5)
    texts = ["", None, "é漢 word, two\n" * 50, "a" * 5000 + "." * 5000 + "b c " * 3000, "\U0001f600x"]
    texts += ["".join(rng.choice(["a", "bb" * 40, " ", "é", "\n", "Z"]) for _ in range(800))
              for _ in range(20)]
    found = fill_middle.token_boundaries(pa.array(["skipped", *texts])[1:])
    for span in (4, 64, 512):
        for bound in (0, 3, 100):
            index = fill_middle.fit_rank_index(found, bound, span)
            assert np.abs(index.residuals.astype(int)).max() <= bound
            assert (index.offset(np.arange(found.offsets.size)) == found.offsets).all()
    for text, a, b in zip(texts, found.first, found.first[1:]):
        ends = [0, *[m.end() for m in TOKEN.finditer(text or "")]]
        assert found.offsets[a:b].tolist() == ends


def example_of(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle),
                f"<S>{suffix}<P>{prefix}<M>{middle}")
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_examples_equal_brute_force_and_restore(spark):
    rng = random.Random(9)
    texts = [None, "", "a", "<P", "x<S>y", "<", "word " * 40_000 + "é"]
    texts += ["".join(rng.choice(["a", "<", "S>", "P", "M>", " ", "é", "\U0001f600", "\r\n", "Zz"])
                      for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (7, texts[7])]
    frame = spark.createDataFrame([(*d, 3, "q") for d in docs],
                                  "doc_id bigint, text string, n int, form string")
    made = fill_middle.fill_in_middle(frame).withColumn(
        "back", fill_middle.restore(fill_middle.F.col("output"), fill_middle.F.col("form")))
    got = [tuple(r) for r in made.collect()]
    want = [(*example_of(i, t), t or "") for i, t in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame.limit(0)).count() == 0
