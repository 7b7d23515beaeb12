"""Conversation repair, sharding and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import conversations, filter_audit, sharding

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- conversations ------------------------------------------------------------------


def all_repairs(rows):
    """Every outcome of every edit of ``(role, text, gone, cut)``, by trying all of them,
    with at most two turns inserted at a place: (cost, edits, repaired)."""
    names = {"u": "user", "a": "assistant"}

    def tails(i, roles):
        for made in ("", "u", "a", "ua", "au"):
            for rest in ends(i, roles + made):
                yield (3 * len(made) + rest[0], "I" * len(made) + rest[1], [names[x] + ":" for x in made] + rest[2])

    def ends(i, roles):
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", roles):
                yield 0, "", []
            return
        role, text, gone, cut = rows[i]
        for cost, edits, made in tails(i + 1, roles):
            yield cost + 4, "D" + edits, made
        if not gone:
            for edit, name, price in [("K", role or "?", 0), ("R", "user", 3), ("R", "assistant", 3)]:  # a role without a letter is none
                for cost, edits, made in tails(i + 1, roles + name[:1]):
                    yield cost + price + 3 * cut, edit + edits, [f"{name}:{text}", *made]

    return min(tails(0, ""), key=lambda x: x[:2])


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["x.", "yes", "ok!\n"]), st.booleans(), st.booleans()), max_size=4)


@settings(max_examples=60, deadline=None)
@given(ROWS)
def test_decoder_finds_the_cheapest_and_least_edits(rows):
    decoder = conversations.Decoder()
    for role, text, gone, cut in rows:
        decoder.row(role, text.encode(), gone, cut)
    cost, edits, made = all_repairs(rows)
    assert decoder.finish() == (cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest())


def forward(rows):
    """The same by whole strings: for each state the least (cost, edits, repaired)."""
    names, best = {"u": "user", "a": "assistant"}, {0: (0, "", [])}
    step = lambda s, x: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, x))

    def grown(best):
        out = []
        for s, (cost, edits, made) in best.items():
            out.append((s, cost, edits, made))
            for new in ("u", "a", "ua", "au"):
                t = s
                for x in new:
                    t = step(t, x) if t is not None else None
                if t is not None:
                    out.append((t, cost + 3 * len(new), edits + "I" * len(new), made + [names[x] + ":" for x in new]))
        return out

    for role, text, gone, cut in rows:
        found = defaultdict(list)
        for s, cost, edits, made in grown(best):
            found[s].append((cost + 4, edits + "D", made))
            for edit, name, price in [] if gone else [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                if (t := step(s, name[:1])) is not None:
                    found[t].append((cost + price + 3 * cut, edits + edit, made + [f"{name}:{text}"]))
        best = {s: min(x, key=lambda y: y[:2]) for s, x in found.items()}
    return min((x[1:] for x in grown(best) if x[0] in (0, 3)), key=lambda y: y[:2])


@pytest.mark.parametrize("seed", range(30))
def test_decoder_on_long_conversations(seed):
    r = random.Random(seed)
    roles = [["user"], ["user", "assistant"], ["system", "user", "assistant", "tool"], ["assistant", "system"]][seed % 4]
    rows = [(r.choice(roles), "x.", r.random() < 0.2, r.random() < 0.3) for _ in range(r.choice([50, 200]))]
    decoder = conversations.Decoder()
    for role, text, gone, cut in rows:
        decoder.row(role, text.encode(), gone, cut)
    cost, edits, made = forward(rows)
    assert decoder.finish() == (cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest())


def test_decoder_holds_little():
    """Ordinary rows are emitted soon; rows that never coalesce stay as text of edits in a
    tree of a handful of nodes."""
    decoder = conversations.Decoder()
    for i in range(2000):
        decoder.row(("user", "assistant")[i % 2], b"x", False, False)
        decoder.row("user", b"", True, False)
    assert sum(map(len, decoder.emitted)) >= 3990
    decoder = conversations.Decoder()
    for _ in range(20_000):
        decoder.row("user", b"x" * 100, False, False)

    def nodes(n):
        return 1 + sum(nodes(k) for k in n.kids)

    assert nodes(decoder.root) <= 7 and len(decoder.alive) <= 4
    assert len(decoder.finish()[1]) >= 20_000


def plain_audit(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv]
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        by[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, _, _ in found if t is not None]
        n, edited, seen = Counter(), [], set()
        for i, (_, role, text) in enumerate(found):
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            n[kind] += 1
            n["illegal"] += i > 0 and found[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            edited.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        cost, edits, made = forward(edited)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def audited(df):
    got = [tuple(r) for r in conversations.damaged_and_repaired(df).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def test_conversations_of_all_kinds(spark):
    r, rows = random.Random(5), []
    for conv in [*range(60), None]:
        for turn in [*range(r.randint(1, 9)), *([None, 3] if conv is None or conv % 7 == 0 else [])]:
            text = r.choice(["Yes.", "No", "  \n", "", None, "Well!\n", "Who?", "a" * 3000 + "."])
            rows.append((conv, turn * 2 if turn and r.random() < 0.2 else turn, r.choice(["user", "assistant", "system", "tool", "", None, "user"]), text))
    rows += rows[::9] + [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (100, None, None, None)]
    rows += [(200, t, ("user", "assistant")[t % 2], f"Text {t % 50}.") for t in range(3000)]  # a large one, with far repeats
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("copies", "digest", "conv", "first", "fate", "n")})
    got, want = audited(df), plain_audit(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_conversations_without_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = audited(spark.createDataFrame([(dropped, 0, "user", "Hi.")], TURNS))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert audited(spark.createDataFrame([], TURNS)) == {}


# --- sharding -----------------------------------------------------------------------


def least_capacity(sizes, shards):
    """Smallest largest sum over all contiguous partitions, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    upto = [0, *itertools.accumulate(sizes)]
    for _ in range(shards):
        best = [0] + [min(max(best[j], upto[i] - upto[j]) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 7), st.sampled_from([2, 5, 512]))
def test_minimax_is_exact_however_coarse_its_looks(sizes, shards, slices):
    upto = [0, *itertools.accumulate(sizes)]
    known = sharding.Boundaries(upto[-1], len(sizes))

    def refine(gaps):
        assert gaps
        for g in sorted(set(gaps), key=lambda g: g.low):
            inside = [x for x in upto if g.low < x < g.high]
            assert len(inside) == g.inner
            by = defaultdict(list)
            for x in inside:
                by[(x - g.low) * slices // (g.high - g.low)].append(x)
            known.learn(g, [(min(x), max(x), len(x)) for x in by.values()])

    capacity, cuts = sharding.minimax(known, shards, refine)
    if not sizes:
        assert cuts == []
        return
    assert capacity == least_capacity(sizes, shards)
    assert cuts[0] == 0 and len(cuts) <= shards and set(cuts) <= set(upto)
    assert all(0 < b - a <= capacity for a, b in zip(cuts, [*cuts[1:], upto[-1]]))
    assert len(cuts) == min(shards, len(sizes)) or capacity == max(sizes)


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert all(r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups, sums = defaultdict(set), Counter()
    for r in got:
        groups[(r["size"], r.text_crc32)].add(r.shard)
        sums[r.shard] += r["size"]
    assert all(len(x) == 1 for x in groups.values())
    return sums


def test_shards_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sums = check_shards(rows, sharding.shard(docs).collect(), 16)
    group = Counter()
    for _, t in rows:
        group[t] += len((t or "").encode()) + 1
    assert len(sums) == 16 and max(sums.values()) <= sum(sums.values()) / 16 + max(group.values())
    # the capacity is the least one for the order that it says
    total = sum(group.values())
    order = sorted(group, key=lambda t: (-group[t], hashlib.sha256(t.encode()).digest()) if group[t] * 16 > total else (0, hashlib.sha256(t.encode()).digest()))
    assert max(sums.values()) <= least_capacity([group[t] for t in order], 16)
    few = check_shards(rows, sharding.shard(docs, shards=3, part_rows=20).collect(), 3)
    assert max(few.values()) - min(few.values()) <= 2 * max(group.values())


def test_a_hot_group_gets_a_shard_and_the_others_stay_even(spark):
    rows = [(i, "same text " * 20) for i in range(1000)] + [(1000 + i, f"other text {i} " * 15) for i in range(2000)]
    sums = check_shards(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), part_rows=100).collect(), 16)
    others = [n for s, n in sums.items() if s]
    assert sums[0] == 201 * 1000 and len(others) == 15 and max(others) - min(others) < 1000


def test_shards_of_odd_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (2, ""), (None, "é"), (None, "é"), (3, "word " * 100_000), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("size", "shard", "part", "idx", "before", "start", "row", "digest", "place", "at", "no", "first", "slot")})
    check_shards(rows, sharding.shard(df).collect(), 16)
    assert sharding.shard(df.where("false")).collect() == []
    assert [(r.shard, r.slot) for r in sharding.shard(spark.createDataFrame([(7, "x")], "doc_id long, text string")).collect()] == [(0, 0)]


# --- filter audit -------------------------------------------------------------------


def test_constrained_least_squares_give_shapley_values():
    r = random.Random(3)
    for n in (2, 3, 5):
        value = [0] + [r.randint(0, 1000) for _ in range(2**n - 1)]
        want = [0] * n
        orders = list(itertools.permutations(range(n)))
        for order in orders:
            before = 0
            for f in order:
                want[f] += value[before | 1 << f] - value[before]
                before |= 1 << f
        assert [x * len(orders) for x in filter_audit.shapley(value, n)] == want


def plain_filters(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out = defaultdict(list)
    for d, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else "")
        fails += ("D" if re.search("[#$%&*|]", t) else "") + ("E" if d is not None and t in first and first[t] < d else "")
        out[part or ""].append((fails, d in good, d in toxic))
    table = {}
    for part, docs in out.items():
        shares = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] for x in docs) - len(gone)
                table[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[0] == f for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shares[f] += len(gone)
        for (p, order, step), x in table.items():
            if p == part:
                x.append(shares[order[step - 1]])
    return table


def test_filters_against_plain_version(spark):
    from pyspark.sql import functions as F

    r, rows = random.Random(8), []
    for i in range(120):
        text = " ".join(r.choices([f"w{k}" for k in range(r.choice([5, 400]))] + ["Big", "A#b"][: r.choice([0, 0, 1, 2])], k=r.choice([0, 3, 150, 220, 300])))
        rows.append((i if i % 17 else None, r.choice([text, text, None, "same"]), r.choice(["x", "y", None, ""])))
    rows += rows[:20] + [(500, "word Ünï\U0001f600 " * 30_000, "y"), (501, "word Ünï\U0001f600 " * 30_000, "y")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 120, 2), *range(0, 60, 5)]] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("mask", "digest", "part", "first", "good", "toxic", "n", "words", "t")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))
    got = {(x.part, x.filter_order, x.step): [x[c] for c in filter_audit.COUNTS] for x in filter_audit.audit(docs, known).collect()}
    assert got == plain_filters(rows, labels)
    assert filter_audit.audit(docs.where("false"), known).collect() == []
    assert all(x.good_lost == 0 for x in filter_audit.audit(docs, known.where("false")).collect())
