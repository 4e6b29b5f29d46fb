"""Order within license spans, where they stand, and recall of edited notices."""

import random

from grovesift.llm import license_scan

FILL = "lorem ipsum dolor amet elit sed tempor magna aliqua veniam quis nostrud".split()


def test_words_in_another_order_are_no_license(spark):
    rng, rows = random.Random(1), []
    long = [(t, label) for t, label in license_scan.TEMPLATES if len(t.split()) > 12]
    for k, (text, _) in enumerate(long * 10):
        w = text.split()
        pairs = [w[i : i + 2] for i in range(0, len(w), 2)]
        rng.shuffle(pairs)
        rows.append((k, " ".join(x for p in pairs for x in [*p, *rng.sample(FILL, 2)])))
    scores = sorted(r.score for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=()).collect())
    assert scores[len(scores) * 9 // 10] < 0.2 and scores[-1] < 0.4, scores[-10:]


def test_spans(spark):
    rows = []
    for k, (text, label) in enumerate(license_scan.TEMPLATES):
        rows.append((k, f"some words before, {text.title()}. And words behind"))
    rows.append((100, "no license at all"))
    got = {}
    for r in license_scan.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.label, r.first, r.last, r.share))
    for k, (text, label) in enumerate(license_scan.TEMPLATES):
        assert (label, 3, 2 + len(text.split()), 1.0) in got[k]
    assert 100 not in got


def test_recall_of_edited_notices(spark):
    """A twentieth and a tenth of the words of the long templates replaced, lost or added to."""
    rng, found = random.Random(4), {}
    long = [(t, label) for t, label in license_scan.TEMPLATES if len(t.split()) > license_scan.LONG]
    for share in (0.05, 0.1):
        rows = []
        for k in range(40 * len(long)):
            w = long[k % len(long)][0].split()
            for _ in range(max(1, round(share * len(w)))):
                i = rng.randrange(1, len(w))
                how = rng.randrange(3)
                w[i : i + (how != 1)] = [] if how == 0 else [rng.choice(FILL)]
            rows.append((k, f"{' '.join(rng.choices(FILL, k=30))} {' '.join(w)} {' '.join(rng.choices(FILL, k=30))}"))
        labels = {r.doc_id: r.labels.split(",") for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=()).collect()}
        found[share] = sum(long[k % len(long)][1] in labels[k] for k, _ in rows) / len(rows)
    print(found)
    assert found[0.05] >= 0.9 and found[0.1] >= 0.6, found
