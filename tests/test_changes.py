"""Fingerprints that updates carry on, and which operations need to read."""

import pytest
from pyspark.sql import functions as F

from quadframe.errors import Denied
from quadframe.operators import datasets as D
from quadframe.operators import patterns, updates

QUADS = "g string, s string, p string, o string"


def quads(spark, *found):
    return spark.createDataFrame([*found], QUADS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_fingerprint_is_that_of_the_set(spark):
    some = [(g, f"<urn:{i}>", "<urn:p>", f'"{i % 3}"') for g in (None, "<urn:a>", "<urn:b>") for i in range(20)]
    before = D.Dataset.of(quads(spark, *some))
    added = quads(spark, (None, "<urn:x>", "<urn:p>", '"1"'), ("<urn:c>", "<urn:x>", "<urn:p>", '"1"'))
    removed = quads(spark, *[q for q in some if q[0] == "<urn:b>"], some[3])
    after = updates.chain(updates.insert_data(added), updates.delete_data(removed))(before)
    now = D.fingerprint(after)
    assert rows(D.fingerprint_after(D.fingerprint(before), added, removed)) == rows(now)
    assert rows(D.fingerprint(D.Dataset.of(quads(spark, *some[::-1])))) == rows(D.fingerprint(before))
    assert rows(D.changed_graphs(D.fingerprint(before), now)) == sorted([(None,), ("<urn:b>",), ("<urn:c>",)], key=str)
    assert rows(D.changed_graphs(now, now)) == []
    # a repeated quad does not cancel out
    twice = D.fingerprint(D.Dataset.of(quads(spark, some[0], some[0], some[1])))
    assert twice.first().high != D.fingerprint(D.Dataset.of(quads(spark, some[1]))).first().high
    assert D.fingerprint(D.Dataset.of(quads(spark, some[0]).limit(0))).collect() == []


def test_what_reads_needs_the_grant(spark):
    d = D.Dataset.of(quads(spark, ("<urn:a>", "<urn:s>", "<urn:p>", '"1"')))
    write = D.Capability.of("write")
    where = lambda x: patterns.match(x.named(), "?s", "<urn:p>", "?o")
    blind = [updates.insert_data(d.quads), updates.delete_data(d.quads), updates.clear("ALL"), updates.drop("<urn:a>"), updates.create("<urn:z>"), updates.copy("<urn:a>", "<urn:a>"), updates.move("<urn:a>", "<urn:a>")]
    assert not any(map(updates.reads, blind)) and not updates.reads(updates.chain(*blind))
    looking = [updates.modify(where, delete=[("?s", "<urn:p>", "?o", "<urn:a>")]), updates.copy("<urn:a>", "<urn:b>"), lambda x: x, updates.chain(blind[0], lambda x: x)]
    assert all(map(updates.reads, looking))
    for operation in looking:
        with pytest.raises(Denied):
            updates.update(d, operation, write)
    assert rows(updates.update(d, updates.copy("<urn:a>", "<urn:a>"), write)[0].quads) == rows(d.quads)
    assert updates.update(d, blind[0], write)[0].quads.where(F.col("g").isNull()).isEmpty()
