"""Conversation repair against a plain search over all edits, whole and in chunks."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from ledgerloom.llm import repair
from ledgerloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, id string, k string, chunk string, letters string"


def plain_damage(rows):
    """(conv, turn, role, text) after damage, by the wording of the task."""
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Least (cost, audit) over all edit sequences, and the rows it gives."""
    sys.setrecursionlimit(100_000)
    roles = [r[2][:1] for r in rows]
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            for role in follows[last]:
                if role != "s":
                    cost, audit, out = best(i, role, inserted + 1)
                    options.append((cost + 2, "I" + audit, ({"u": "user:", "a": "assistant:"}[role], *out)))
        if i < len(rows):
            cost, audit, out = best(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if roles[i] in follows[last]:
                    cost, audit, out = best(i + 1, follows[last][roles[i]], 0)
                    options.append((cost + extra, "K" + audit, (f"{rows[i][2]}:{rows[i][3]}", *out)))
                for role in ("user", "assistant"):
                    if role[0] in follows[last]:
                        cost, audit, out = best(i + 1, role[0], 0)
                        options.append((cost + 2 + extra, "R" + audit, (f"{role}:{rows[i][3]}", *out)))
        return min(options, default=(10**9, "~", ()))

    for i in range(len(rows), 0, -50):  # keeps the recursion shallow
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def plain(rows, damage=True):
    conversations = defaultdict(list)
    for r in plain_damage(rows) if damage else rows:
        conversations[r[0]].append(r)
    out = []
    for c in {r[0] for r in rows}:
        got = sorted(conversations[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        faults = plain_faults(got)
        cost, audit, texts = plain_repair(got, faults)
        turns = {r[1] for r in got if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(got, got[1:], strict=False)]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((str(c), gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, **kw):
    data = spark.createDataFrame([(*r, "i", "k", "c", "l") for r in rows], SCHEMA).repartition(4)
    report = repair.with_empty(repair.repair(repair.damaged(data), **kw).report(), data)
    assert report.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in report.collect())


TEXTS = ("Fine.", "Fine. \n", "no end", "", " \t", "Really?", "x ", "é! ", ".!?", "a long text " * 2000 + "end.")


def random_rows(rng, conversations, longest):
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "Sam", "", None, "ulf"))
            text = rng.choice(TEXTS) if rng.random() < 0.4 else None if rng.random() < 0.1 else f"Words {rng.random()}" + rng.choice(".!? x")
            rows.append((c if c else None, None if rng.random() < 0.05 else t + rng.choice((0, 0, 0, 3)), role, text))
    return rows


@pytest.mark.parametrize(("seed", "bits", "passes"), [(1, 16, 6), (2, 1, 6), (3, 1, 0), (4, 2, 1)])
def test_against_plain_search(spark, seed, bits, passes):
    rows = random_rows(random.Random(seed), 60, 12)
    assert found(spark, rows, chunk_bits=bits, passes=passes) == plain(rows)


@pytest.mark.parametrize("passes", [0, 2, 50])
def test_long_stretch_that_hands_its_vector_on(spark, passes):
    """Many users in a row keep the difference between states: every pass settles one more chunk, doubling the rest."""
    rows = [(1, i, "user", f"Text {i}.") for i in range(90)] + [(1, 90, "assistant", "So."), (1, 91, "system", "No."), (2, 0, "system", "Only.")]
    assert found(spark, rows, chunk_bits=2, passes=passes) == plain(rows)


def test_hot_conversation_of_one_row_repeated(spark):
    rows = [(1, 5, "user", "Again and again!")] * 3000 + [(1, 6, "assistant", "Yes."), (2, 0, "user", "Hi")]
    assert found(spark, rows, chunk_bits=6) == plain(rows)


def test_repaired_rows(spark):
    rows = random_rows(random.Random(9), 30, 9)
    data = spark.createDataFrame([(*r, "i", "k", "c", "l") for r in rows], SCHEMA)
    fixed = repair.repair(repair.damaged(data), chunk_bits=1)
    report = {r.conv_id: r for r in fixed.report().collect()}
    texts = defaultdict(list)
    for r in sorted(fixed.rows().collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(texts[r.conv_id]) and (r.edit == "I") <= (r.text == "" and r.turn is None)
        texts[r.conv_id].append((r.role, r.text, r.edit))
    for c, r in report.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0][0] for x in texts[c]))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in texts[c]).encode()).hexdigest()
        assert "".join(x[2] for x in texts[c]) == r.audit.replace("D", "")


def test_empty(spark):
    assert found(spark, []) == []
    gone = next((c, 0, "user", "Hi.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [gone]) == [(str(gone[0]), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_all_vectors_are_few():
    assert len(repair.vectors()) == 16 and repair.END == (0, 4, 2, 0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, sf).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain(rows)
