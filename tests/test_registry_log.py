"""The registry as a change log."""
import random

import pytest

from skein.sources import registry_log as log

COLS = [f.split()[0] for f in log.EVENTS.split(", ")]
STOPPED = "{} crawled, {} remaining, Stopped."


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLS) for r in rows], log.EVENTS)


def random_events(n=400, seed=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(log.KINDS)
        e = {"event_id": f"e{i}", "seq": i, "kind": kind, "pageid": f"p{r.randrange(12)}"}
        if kind in ("register", "delete"):
            e["owner"] = f"u{r.randrange(4)}"
        if kind == "register":
            e["url"], e["status"] = f"https://{e['pageid']}/{i}", r.choice(["Pending", STOPPED.format(i, 0)])
        if kind == "status":
            e["status"] = r.choice([STOPPED.format(i, i % 7), "Pending", None])
        if kind == "site_key":
            e["host"] = f"h{r.randrange(5)}"
        out.append(e)
    return out


def play(events):
    """One event after the other; a crawl marks a status once."""
    sites, keys, marked = {}, {}, set()
    for e in sorted({e["event_id"]: e for e in reversed(events)}.values(), key=lambda e: e["seq"]):
        p = e["pageid"]
        if e["kind"] == "register" and (p, e["owner"]) not in sites:
            sites[p, e["owner"]] = (e["url"], e["status"])
        elif e["kind"] == "delete":
            sites.pop((p, e["owner"]), None)
            marked.discard((p, e["owner"]))
        elif e["kind"] == "status" and e["status"] is not None:
            for k in [k for k in sites if k[0] == p]:
                sites[k] = (sites[k][0], e["status"])
                marked.discard(k)
        elif e["kind"] == "crawling":
            for k in [k for k in sites if k[0] == p and k not in marked]:
                parts = sites[k][1].split(",")
                if len(parts) >= 2:
                    sites[k] = (sites[k][0], f"{parts[0]}, {parts[1]}, Crawling...")
                marked.add(k)
        elif e["kind"] == "site_key":
            keys[p] = e["host"]
    return sorted((p, o, u, s) for (p, o), (u, s) in sites.items()), sorted(keys.items())


def state(tables):
    return (sorted(tuple(r) for r in tables["sites"].collect()), sorted(tuple(r) for r in tables["site_keys"].collect()))


@pytest.mark.parametrize("seed", [6, 7])
def test_fold_equals_playing_the_events(spark, seed):
    events = random_events(seed=seed)
    assert state(log.fold(frame(spark, events))) == play(events)


def test_log_with_repeats_failures_and_compaction(spark, tmp_path):
    root, events = str(tmp_path / "log"), random_events()
    assert state(log.load(spark, root)) == ([], [])
    log.compact(spark, root)                                    # nothing there yet
    a, b, c = events[:150], events[150:280], events[280:]
    log.append(frame(spark, a), root, 1)
    log.append(frame(spark, a), root, 1)                        # the same save again
    assert state(log.load(spark, root)) == play(a)
    frame(spark, b).write.parquet(f"{root}/events/batch=2")     # a save that fails half-way
    assert state(log.load(spark, root)) == play(a)
    log.append(frame(spark, b + a[:40]), root, 2)               # its retry, with events of batch 1 again
    assert state(log.load(spark, root)) == play(a + b)
    log.compact(spark, root)
    log.compact(spark, root)
    assert state(log.load(spark, root)) == play(a + b)
    assert log.read(spark, root).count() < len(a + b) / 2
    log.append(frame(spark, c + b), root, 3)                    # compacted events come late
    assert state(log.load(spark, root)) == play(events)
    frame(spark, c).limit(0).write.parquet(f"{root}/events/base=3")     # a compaction that fails half-way
    assert state(log.load(spark, root)) == play(events)
    log.compact(spark, root)
    assert state(log.load(spark, root)) == play(events)
    with pytest.raises(ValueError):
        log.events(frame(spark, a), "rename", None, None)


def test_one_site_with_most_events(spark):
    """The fold combines before it shuffles: no window over a site's events."""
    from test_plans import plan_of
    plan = plan_of(log.fold(frame(spark, random_events(50)))["sites"])
    assert "Window" not in plan
