"""Structure repair and the prefix trie against plain Python."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from pulseloom.llm import prefix_trie, repair

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def rank(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_repair(rows):
    """All reports for rows (conv_id, turn, role, text), damaged; edits by exhaustive search."""
    out = {}
    for c in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            after += [(c, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=rank)
        faults, seen = [], set()
        for _, _, role, text in after:
            solid = WHITE.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        best = []

        def search(k, roles, cost, audit, body, inserts):
            initials = "".join(r[:1] or "-" for r in roles)
            if not re.fullmatch(r"(s?(ua)*u?)?", initials):
                return
            if k == len(after) and re.fullmatch(r"(s?(ua)+)?", initials):
                best.append((cost, audit, "\n".join(body)))
            if inserts < 2:
                for r in ("user", "assistant"):
                    search(k, [*roles, r], cost + 5, audit + "I", [*body, f"{r}:"], inserts + 1)
            if k < len(after):
                _, _, role, text = after[k]
                search(k + 1, roles, cost + 2, audit + "D", body, 0)
                if faults[k] not in ("blank", "duplicate"):
                    more = 5 * (faults[k] == "truncated")
                    search(k + 1, [*roles, role], cost + more, audit + "K", [*body, f"{role}:{text}"], 0)
                    for r in ("user", "assistant"):
                        search(k + 1, [*roles, r], cost + 1 + more, audit + "R", [*body, f"{r}:{text}"], 0)

        search(0, [], 0, "", [], 0)
        cost, audit, body = min(best)
        turns = [t for _, t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(after, after[1:], strict=False)]
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(body))
    return out


def odd_conversations(seed, n=120, most=4):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), None, -5]:
        for t in range(r.randint(1, most)):
            turn = None if r.random() < 0.05 else t + 2 * (r.random() < 0.1)
            role = r.choice(["user", "assistant", "user", "assistant", "system", "system", None, "", "tool", "usher"])
            text = r.choice(["Yes.", "No!", "And so", "", " \t", None, "Dots. end", "Why? \n", "é.", "same."]) if r.random() < 0.7 else f"Words {r.randint(0, 9)}."
            rows.append((c, turn, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_is_the_cheapest(spark):
    rows = odd_conversations(1)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", kind int, audit string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(df).collect()}
    assert got == plain_repair(rows)
    assert {"K", "R", "D"} == set("".join(v[6] for v in got.values()))  # an insert costs more than deletes that do as well


def test_repair_of_nothing_and_of_long_conversations(spark, monkeypatch):
    assert repair.repair_digests(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(700)]
    got = repair.repair(spark.createDataFrame([(*r, False) for r in rows], SCHEMA + ", dropped boolean")).collect()
    assert len(got) == 1 and got[0].cost == 0 and got[0].audit == "K" * 700 and got[0].repaired == "\n".join(f"{r[2]}:{r[3]}" for r in rows)


def test_lots_part_no_conversation(monkeypatch):
    monkeypatch.setattr(repair, "ROWS", 10)
    keys = [None] * 3 + [1] * 40 + [2] + [3] * 5 + [4] * 30 + [5] * 2
    batches = [pa.record_batch([pa.array(keys[k : k + 4], pa.int64()), pa.array(range(k, min(k + 4, len(keys))))], ["c", "n"]) for k in range(0, len(keys), 4)]
    lots = [x.to_pydict() for x in repair._lots(batches, "c")]
    assert [n for x in lots for n in x["n"]] == list(range(len(keys))) and len(lots) > 2
    for a, b in zip(lots, lots[1:], strict=False):
        assert a["c"][-1] != b["c"][0]


def plain_trie(rows):
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], rank(r))):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(c - 20 * int(c / 20)), [])[:h] + own[h:]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(z) > len(q) and z[: len(q)] == q for z in nodes)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == list(p))))
        out[min(members), len(p)] = (min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, sha(ends))
    return out


def as_dict(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_nodes(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "SPAN", 16)
    r = random.Random(seed)
    rows = odd_conversations(seed, 150, 5)
    for c in range(200, 330):  # many copies, and a shared start
        rows += [(c, 0, "user", "Hello there."), (c, 1, "assistant", "a b c" if c % 3 else f"{c}")]
        rows += [(c, 2, "user", r.choice(["more", "less words here"]))] * (c % 2)
    assert as_dict(prefix_trie.family_trie(spark.createDataFrame([(*x, b"k") for x in rows], SCHEMA + ", name binary"))) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.family_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.family_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
