import datetime as dt
import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from pulseloom.llm import fixity, url_lists


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, length int, status string")


def test_audit_finds_planted_damage_only(spark):
    rng = random.Random(2)
    rows = [(k, f"http://h{k % 5}.example/{k}", "é" * rng.randrange(60) or None, 1, "x") for k in range(3 * 1024 + 77)]
    records = fixity.archive(pages_of(spark, rows))
    index = fixity.record_index(records)
    bad, lost = {5, 1023, 1024, 2000, 3100}, {0, 17, 1500, 2047, *range(3140, 3 * 1024 + 77)}  # losses at a begin, inside and at an end
    changed = records.withColumn("record", F.when(F.col("page_id").isin(*bad), F.concat(F.lit("X"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))).where(~F.col("page_id").isin(*lost))
    replica = fixity.record_index(changed)
    more = replica.where("page_id in (30, 2500)").withColumn("id", F.concat("id", F.lit("+")))
    found = {(r.id, r.fault) for r in fixity.audit(index, replica.union(more)).collect()}
    assert found == {(str(k), "altered") for k in bad} | {(str(k), "missing") for k in lost} | {("30+", "extra"), ("2500+", "extra")}
    assert fixity.audit(index, index).count() == 0


def test_audit_descends_only_where_nodes_differ(spark):
    levels = [fixity.tree(fixity.leaves(fixity.record_index(fixity.archive(pages_of(spark, [(k, "u", str(k + (k == 40) * x), 0, "") for k in range(600)])))), 3) for x in (0, 1)]
    under = None
    for level in (3, 2, 1, 0):
        under = fixity.differing(levels[0][level], levels[1][level], under)
        assert under.select("place").collect() == [(40 // 16**level,)]


def test_audit_of_odd_pages(spark):
    rows = [(None, None, None, 0, ""), (None, "v", None, 0, ""), (1, None, "", 0, ""), (1, None, "", 0, ""), (2, "u", "x" * 200_000, 0, "")]
    got = fixity.audit_pages(pages_of(spark, rows)).collect()
    assert len(got) == 5 and sorted(r.start for r in got if r.file == 0)[0] == 0 and len({r.file for r in got if r.file < 0}) == 2
    assert fixity.audit_pages(pages_of(spark, [])).count() == 0
    index = fixity.record_index(fixity.archive(pages_of(spark, rows)))
    assert {r.fault for r in fixity.audit(index, index.where("false")).collect()} == {"missing"}
    assert {r.fault for r in fixity.audit(index.where("false"), index).collect()} == {"extra"}


def test_audit_of_stored_archives(spark, tmp_path):
    """Two folders of WARC files, plain and with gzip members: a record altered, one lost and one added inside, and a file lost."""

    def record(k, body):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    for name, zipped in (("a.warc", False), ("b.warc.gz", True), ("c.warc", False)):
        for side in ("one", "two"):
            rows = [record(f"{name}-{k}", b"x" * k + b"\r\n\r\n") for k in range(300)]
            if side == "two":
                if name == "c.warc":
                    continue
                rows[100] = rows[100].replace(b"xx", b"xy", 1)
                rows[200:201] = [record(f"{name}-new", b"new"), rows[200]]
                del rows[50]
            (tmp_path / side).mkdir(exist_ok=True)
            (tmp_path / side / name).write_bytes(b"".join(gzip.compress(r) if zipped else r for r in rows))
    one, two = (fixity.read_archive(spark, str(tmp_path / side)) for side in ("one", "two"))
    assert one.count() == 900 and one.where("file = 'a.warc'").agg(F.sum("length")).first()[0] == (tmp_path / "one" / "a.warc").stat().st_size
    found = {(r.file, r.id, r.fault) for r in fixity.audit(one, two).collect()}
    want = {(n, f"<urn:r:{n}-{k}>", f) for n in ("a.warc", "b.warc.gz") for k, f in ((100, "altered"), (50, "missing"), ("new", "extra"))}
    assert found == want | {("c.warc", f"<urn:r:c.warc-{k}>", "missing") for k in range(300)}


def brute_verdict(url_host, day, events):
    if url_host is None or day is None:
        return "clear", ""
    parts = url_host.split(".")
    domains = {".".join(parts[k:]) for k in range(len(parts))}
    active = {}
    for name, pattern, action, at in sorted((e for e in events if None not in e), key=lambda e: (e[3], e[2] == "remove")):
        if pattern in domains and at <= day and action in ("add", "remove"):
            active[name, pattern] = action == "add"
    held = [(n, p.count(".")) for (n, p), on in active.items() if on]
    block, allow = (max((d for n, d in held if (n == "allow") == a), default=-1) for a in (False, True))
    return ("clear" if block < 0 and allow < 0 else "allowed" if allow >= block else "blocked"), ",".join(sorted({n for n, _ in held}))


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    day = lambda: start + dt.timedelta(rng.randrange(40))
    hosts = ["a.b.example", "b.example", "example", "c.example", "x.y.b.example"]
    events = [(rng.choice(["spam", "adult", "allow"]), rng.choice(hosts), rng.choice(["add", "remove"]), day()) for _ in range(60)] + [(None, "example", "add", start), ("spam", None, "add", start), ("spam", "example", "add", None), ("spam", "c.example", "??", start)]
    rows = [(k, f"HTTPS://u:p@{rng.choice(hosts).upper()}:80/x?y#z", day()) for k in range(300)] + [(900, None, start), (901, "nonsense", start), (902, "http:///x", start), (903, "http://example./", None)]
    captures = spark.createDataFrame([(*r, 1) for r in rows], "id long, url string, at date, verdict int")
    got = {r.id: (r.verdict, r.lists) for r in url_lists.judge(captures, spark.createDataFrame(events, "list string, pattern string, action string, day date"), "url", "at").collect()}
    for k, url, at in rows:
        name = url.split("//")[1].split("@")[-1].split("/")[0].split(":")[0].rstrip(".").lower() or None if url and "//" in url else None
        assert got[k] == brute_verdict(name, at, events), (k, url, at)


def test_url_lists_without_rows(spark):
    none = spark.createDataFrame([], "list string, pattern string, action string, day date")
    captures = spark.createDataFrame([(1, "http://a.b/", dt.date(2024, 1, 1))], "id long, url string, at date")
    assert [r.verdict for r in url_lists.judge(captures, none, "url", "at").collect()] == ["clear"]
    assert url_lists.judge(captures.where("false"), none, "url", "at").count() == 0


def test_captures_need_no_key(spark, monkeypatch):
    monkeypatch.setattr(url_lists, "KEYED", 3)
    start = dt.date(2024, 1, 1)
    rows = [(8, "http://good.test/"), (8, "http://bad.example/"), (None, "http://bad.example/x"), (None, "http://a.bad.example/"), (None, None)] + [(9, "http://bad.example/")] * 3000
    captures = spark.createDataFrame([(*r, start) for r in rows], "id int, url string, at date")
    events = spark.createDataFrame([("spam", "bad.example", "add", start), ("allow", "a.bad.example", "add", start)], "list string, pattern string, action string, day date")
    got = sorted(((r.id, r.host, r.verdict) for r in url_lists.judge(captures, events, "url", "at").collect()), key=str)
    want = [(8, "good.test", "clear"), (8, "bad.example", "blocked"), (None, "bad.example", "blocked"), (None, "a.bad.example", "allowed"), (None, None, "clear")] + [(9, "bad.example", "blocked")] * 3000
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("fault", ["lost", "new", "altered"])
def test_one_fault_in_a_stored_archive_is_one_path(spark, tmp_path, fault):
    def record(k, body):
        return f"WARC/1.0\r\nWARC-Record-ID: <urn:r:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    rows = [record(k, b"x" * (k % 50)) for k in range(3000)]
    other = {"lost": rows[:1200] + rows[1201:], "new": rows[:1200] + [record("new", b"n" * 77)] + rows[1200:], "altered": rows[:1200] + [record(1200, b"longer" * 9)] + rows[1201:]}[fault]
    levels = []
    for side, data in (("one", rows), ("two", other)):
        (tmp_path / side).mkdir()
        (tmp_path / side / "a.warc").write_bytes(b"".join(data))
        levels.append(fixity.tree(fixity.leaves(fixity.read_archive(spark, str(tmp_path / side))), fixity.HEIGHT))
    under = None
    for level in range(fixity.HEIGHT, -1, -1):
        under = fixity.differing(levels[0][level], levels[1][level], under)
        assert under.count() == 1, level


def test_gzip_members_in_linear_time():
    body = random.Random(1).randbytes(3000)
    record = b"WARC/1.0\r\nContent-Length: 3000\r\n\r\n" + body + b"\r\n\r\n"
    member = gzip.compress(record, 1)
    times = []
    for n in (2000, 16000):  # 6 and 50 MB
        raw = member * n
        begun = time.process_time()
        found = list(fixity._records(raw))
        times.append(time.process_time() - begun)
        assert len(found) == n and found[-1] == (len(member) * (n - 1), len(member), record)
    assert times[1] < 20 * times[0] + 0.5
    cut = member * 3 + member[:100]
    assert [(a, n) for a, n, _ in fixity._records(cut)] == [(k * len(member), len(member)) for k in range(3)] + [(3 * len(member), 100)]
    assert list(fixity._records(cut))[-1][2] == member[:100] and list(fixity._records(b"")) == []
    damaged = member + b"\x1f\x8b" + b"rubbish" * 9
    assert len(list(fixity._records(damaged))) == 2
