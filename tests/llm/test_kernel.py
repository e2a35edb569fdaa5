import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ladderline.llm import boosting, kernel, shared

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\rabAZé😀\x1c .", max_size=40)), max_size=6)


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_words_equal_the_pattern(rows):
    found, hashes = [], {}
    for at, data, offsets in kernel.slices(pa.array(rows, pa.string()), 16):
        w = kernel.Words(data, offsets)
        assert len(found) == at
        h = w.hashes()
        for i in range(len(offsets) - 1):
            own = [data[a:b].tobytes().decode() for a, b in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]])]
            found.append(own)
            for word, value in zip(own, h[w.ptr[i] : w.ptr[i + 1]]):
                key = re.sub("[A-Z]", lambda m: m[0].lower(), word)
                assert hashes.setdefault(key, value) == value == kernel.word_hash(word)
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    assert len(set(hashes.values())) == len(hashes)


def test_bitmap_is_bounded_and_exact(spark):
    ids = np.arange(0, 5000, 7)
    slots = kernel.id_slots(ids, 16)
    words = shared.bitmap(spark.createDataFrame([(int(s),) for s in slots], "slot long"), 16)
    assert len(words) == 1 << 10 and shared.in_bitmap(words, slots).all()
    assert shared.in_bitmap(words, np.arange(1 << 16)).sum() == len(set(slots.tolist()))


def test_trees_learn_and_agree_with_their_sql(spark):
    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.7)).astype(float)
    forest = boosting.fit(x, y, trees=40)
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:20]], "a double, b double, c double")
    got = [v[0] for v in df.selectExpr(forest.sql(["a", "b", "c"])).collect()]
    assert np.allclose(got, forest.raw(x[:20]))


def test_isotonic_is_monotone():
    r = np.random.default_rng(2)
    s = r.random(300)
    xs, ys = boosting.isotonic(s, (r.random(300) < s).astype(float))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_a_very_long_text_leaves_no_tables_behind(monkeypatch):
    monkeypatch.setattr(kernel, "KEPT", 64)
    monkeypatch.setattr(kernel, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    long = "word " * 100
    a, b = (kernel.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).hashes() for t in (long, "word"))
    assert (a == b[0]).all() and len(kernel._POWERS[0]) <= 64
