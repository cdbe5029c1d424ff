"""Wanted episodes against a feed's entries: plain Python compares all pairs; the plan meets them once."""

import random
import re

from leafmill.operators.linkage import match_entries

KINDS = "feed_id bigint, {} bigint, {} string, title string"


def _key(url):
    found = re.match(r"https?://([^/?#]*)([^?#]*)", url or "")
    return f"/{found[1]}{found[2]}".lower() if found and "." in found[2].rpartition("/")[2] else None


def _fold(title):
    return re.sub(r"[\W]+", " ", (title or "").lower()).strip()


def _expected(wanted, entries):
    out = set()
    for feed, number, url, title in wanted:
        key, same, named = _key(url), [], []
        for other, pos, file, name in entries:
            if other == feed:
                there = _key(file)
                if key and there and (key.endswith(there) or there.endswith(key)):
                    same.append(pos)
                if _fold(title) and _fold(title) == _fold(name):
                    named.append(pos)
        if same or named:
            out.add((feed, number, min(same or named)))
    return out


def test_first_entry_by_file_or_title(spark):
    chance = random.Random(5)

    def url():
        parts = [chance.choice(["a.example", "b.example", "r", "x"]) for _ in range(chance.randint(0, 2))] + [chance.choice(["e1.mp3", "e2.mp3", "E1.MP3?u=1", "plain", ""])]
        return chance.choice([None, "", "https://" + chance.choice(["t.example", "a.example"]) + "/" + "/".join(parts)])

    title = lambda: chance.choice([None, "", "!?", "One: two", "one two", "/a.example/e1.mp3", "Three", "four"])
    rows = lambda n: [(chance.randint(0, 5), i, url(), title()) for i in range(n)]
    wanted, entries = rows(300), rows(60)
    got = match_entries(spark.createDataFrame(wanted, KINDS.format("wanted_id", "audio_url")), spark.createDataFrame(entries, KINDS.format("pos", "enclosure_url")))
    assert {tuple(r) for r in got.collect()} == _expected(wanted, entries)


def test_both_sides_are_read_once(spark):
    """Each side was computed three times over: for whole keys, for their tails and for titles."""
    columns = "id AS feed_id", "concat('https://a.example/', id, '.mp3') AS {}", "concat('Title ', id) AS title"
    wanted = spark.range(10).selectExpr("id AS wanted_id", *[c.format("audio_url") for c in columns])
    entries = spark.range(10).selectExpr("id AS pos", *[c.format("enclosure_url") for c in columns])
    plan = match_entries(wanted, entries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2
