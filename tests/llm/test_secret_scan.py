"""The battery's power beside many words that aren't secrets, and what stands next to the patterns."""

import base64
import random

from lodestrata.llm import secret_scan
from lodestrata.llm.common import workspace


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(secret_scan.KINDS[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.found] for r in secret_scan.scanned(docs, workspace(spark, "t"), ["doc_id"]).collect()}


def test_keys_are_found_beside_many_identifiers(spark):
    rng = random.Random(6)
    words = "report committee over time index value content management system version final account customer order line price total stream reader writer table column".split()
    camel = lambda: "".join(w.title() for w in rng.sample(words, 5)) + str(rng.randrange(100))
    slug = lambda: "-".join(rng.sample(words, 4)) + f"-{rng.randrange(3000)}"
    key = lambda n: base64.b64encode(rng.randbytes(60)).decode().replace("+", "a").replace("/", "b")[:n]
    texts = [f"use {key(40)} now" for _ in range(100)] + [f"use {key(24)} now" for _ in range(100)] + [f"see {camel()} and {slug()} there" for _ in range(1500)]
    hits = found(spark, texts)
    assert sum(bool(hits[k]) for k in range(100)) >= 90
    assert sum(bool(hits[k]) for k in range(100, 200)) >= 50
    assert sum(bool(hits[k]) for k in range(200, 1700)) <= 15


def test_values_behind_names_and_beside_patterns(spark):
    rng = random.Random(2)
    keys = [base64.b64encode(rng.randbytes(33)).decode().replace("+", "x") for _ in range(60)]
    url = [base64.urlsafe_b64encode(rng.randbytes(33)).decode() for _ in range(60)]
    texts = [f"AWS_ACCESS_NAME={k} and" for k in keys] + [f"GET /v1/files/{u}/a-b_c" for u in url] + [f"password=abcdefghijkl,{k}" for k in keys]
    hits = found(spark, texts)
    assert sum(("random", k) in hits[i] for i, k in enumerate(keys)) >= 54
    assert sum(any(kind == "random" and u in x for kind, x in hits[60 + i]) or any(kind == "random" and x in u for kind, x in hits[60 + i]) for i, u in enumerate(url)) >= 50
    assert all(hits[120 + i][0] == ("assign", "password=abcdefghijkl") for i in range(60))
    assert sum(("random", k) in hits[120 + i] for i, k in enumerate(keys)) >= 54
