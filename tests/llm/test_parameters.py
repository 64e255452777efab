"""Parameters away from their defaults: recall of contained items, links that are refused, dictionaries of large pages."""

import math
import random

import pytest

from fieldmark.llm import decontam, neardup, warc


def words(dice, n):
    return [f"w{dice.randrange(10**7)}" for _ in range(n)]


@pytest.mark.parametrize("contained", [0.8, 0.5, 0.3, 0.28])
def test_contained_items_are_found(spark, contained):
    """Items from two words to several times the samples, in documents that hold just as much as is sought, a little less, or all."""
    dice = random.Random(int(100 * contained))
    items, docs = [], []
    for i, n in enumerate([2, 5, 6, 9, 14, 28, 29, 60, 160, 400, 900] * 3):
        item = words(dice, n)
        items.append((i, " ".join(item)))
        size = max(1, n - 4)
        least = math.ceil(contained * size - 1e-9)
        for shingles in {least, max(0, least - 1), size}:
            part = item[: shingles + 4] if shingles and n >= 5 else item if shingles else []
            at = dice.randrange(300)
            filler = words(dice, dice.choice([300, 3000]))
            docs.append((len(docs), " ".join(filler[:at] + part + filler[at:])))
    sets = lambda rows: {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.split()) for k, t in rows)}
    wanted, held = sets(items), sets(docs)
    truth = {(d, i) for i, s in wanted.items() for d, t in held.items() if len(s & t) / len(s) >= contained}
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench, contained=contained).collect()}
    assert found == truth and len(truth) >= 50


def test_samples_follow_from_the_containment():
    for contained in (1.0, 0.9, 0.8, 0.5, 0.28, 0.1, 0.05):
        drawn, needed = decontam.sampling(contained)
        missed = sum(math.comb(drawn, k) * contained**k * (1 - contained) ** (drawn - k) for k in range(needed))
        assert missed <= decontam.MISSED and needed >= 2 and drawn >= decontam.SAMPLES
    assert decontam.sampling(0.8) == (24, 8)
    for wrong in (0, 0.01, 1.1):
        with pytest.raises(ValueError):
            decontam.sampling(wrong)


def test_links_that_would_be_lost_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for percent in (50, 79, 101):
        with pytest.raises(ValueError):
            neardup.near_duplicates(docs, percent=percent)
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, words=0)


def pages_of(spark, n, size, seed=1):
    dice = random.Random(seed)
    part = [f"<div class='entry e{k}'><a href='/section/{k}'>Read more about {' '.join(words(dice, 4))}</a></div>\n" for k in range(300)]
    rows = [(i, f"http://h{i % 5}.org/{i}", "".join(dice.choice(part) for _ in range(size // 90))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_large_pages_alone_have_a_dictionary(spark):
    pages = pages_of(spark, 60, 60_000)
    samples = warc.sample_records(pages)
    assert len(samples) == 60 and max(map(len, samples)) < 6000
    dictionary = warc.train_dictionary(samples)
    assert len(dictionary) > 10_000
    small = sum(len(warc.zstandard.ZstdCompressor(level=3, dict_data=warc.zstandard.ZstdCompressionDict(dictionary)).compress(r["html"][:3000].encode())) for r in pages.collect())
    assert small < 0.7 * sum(len(warc.zstandard.ZstdCompressor(level=3).compress(r["html"][:3000].encode())) for r in pages.collect())
    back = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert back == {r["page_id"]: len(r["html"]) for r in pages.collect()}


def test_few_small_pages_among_large_ones_and_odd_characters(spark):
    rows = [(i, "http://x.org", "ä€" * 40_000 if i % 2 else "<p>small</p>") for i in range(30)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    samples = warc.sample_records(pages)
    assert len(samples) == 31 and sum(map(len, samples)) <= warc.SAMPLE_BYTES
    assert len(warc.sample_records(pages_of(spark, 500, 900), rows=20)) == 20
    assert warc.sample_records(pages.limit(0)) == []


def test_shuffle_cleanup_is_set_only_meanwhile(spark):
    from fieldmark.llm.common import _SHUFFLES_GO, shuffles_go

    before = spark.conf.get(_SHUFFLES_GO)
    with pytest.raises(KeyError), shuffles_go(spark):
        assert spark.conf.get(_SHUFFLES_GO) == "true"
        raise KeyError
    assert spark.conf.get(_SHUFFLES_GO) == before
