import hashlib
import random
import re

import pytest

from thresher.llm import fim as X
from thresher.llm.queries import op13_fill_in_middle

PIECES = ["a", "\n", "\n\n", "é", "€", "😀", "<P>", "<", "S>", "\r", "\0", "word "]


def texts(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randrange(40))) for _ in range(n)]


def plain(text, name, seed=7, rate=100, spm=50):
    """The rule written with regex and slices of code points."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", X.UNITS)
def test_borders_equal_slices(unit):
    for text in [*texts(3000, 1), "", "\n", "a" * 8, "\n" * 16, "é" * 5]:
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
        borders = X.Borders.of(text.encode(), unit)
        assert borders.units == len(units)
        for k in range(len(units) + 1):
            assert borders.after(k) == len("".join(units[:k]).encode())
        assert X.characters(text.encode()) == len(text)


def test_cut_equals_the_plain_rule():
    for i, text in enumerate(texts(3000, 2)):
        for rate, spm in ((100, 50), (30, 0), (0, 50)):
            got = X.cut(text.encode(), i, rate=rate, spm_rate=spm)
            found = got.units, got.form, got.prefix_chars, got.middle_chars, got.output.decode()
            assert found == plain(text, i, rate=rate, spm=spm)


def test_round_trip_of_all_forms_and_odd_rows(documents):
    rows = [(i, t) for i, t in enumerate(texts(300, 3))]
    rows += [(1, rows[1][1]), (None, "a\nb"), (900, None), (901, ""), (902, "x <M> y"), (903, "long line\n" * 300_000)]
    frame = X.transform(documents(rows))
    found = frame.withColumn("back", X.restored(frame["output"], frame["form"])).collect()
    want = sorted((str(i), t or "", *map(str, plain(t or "", "" if i is None else i))) for i, t in rows)
    got = sorted(
        (str(r.doc_id), r.back, str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in found
    )
    assert got == want and {r.form for r in found} == {"plain", "psm", "spm"}


def test_character_units_and_empty_table(documents):
    (row,) = X.transform(documents([(4, "añ😀b")]), unit="char").collect()
    assert row.n == 4 and row.form != "plain"
    assert X.transform(documents([])).count() == 0
    with pytest.raises(ValueError):
        X.transform(documents([]), unit="page")


def test_query_on_the_given_documents(spark):
    base = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{base}/documents.parquet").collect():
        n, form, p, m, output = plain(r.text or "", r.doc_id)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (output, r.text or "")]
        want[r.doc_id] = (n, form, p, m, *digest)
    found = op13_fill_in_middle(spark, base).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == want
