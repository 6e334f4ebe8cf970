from datetime import datetime

import pytest

from millrace.operators import receipts as R

K = [str(i) * 44 for i in range(6)]
PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>
<div><div>a</div><div>b</div><div>c</div><div><div><div>head</div><div>
<div><table><tbody>{rows}</tbody></table><div>1</div><div>2</div>
<div><div>x</div><div><span>{total}</span></div><div>y</div><div><label>{payment}</label></div></div></div>
<div><div><div><ul><li>Série 1 <b>Emissão: </b>{day} - Via</li></ul></div></div></div>
</div></div></div></div></body></html>"""
ROW = "<tr><td><span>{0}</span><br><span>c</span><span>Qtde.:{1}</span><span>u</span><span>Vl. Unit.: {2}</span></td><td>t<br><span>{3}</span></td></tr>"


def page(total="12,50", day="05/06/2025 07:08:09", rows=(("Café &amp; pão", "2", "3,99", "7,98"),), payment="Dinheiro"):
    return PAGE.format(rows="".join(ROW.format(*r) for r in rows), total=total, day=day, payment=payment)


def parse(spark, *pages):
    rows = spark.createDataFrame([(K[i], p) for i, p in enumerate(pages)], "url string, html string")
    return R.parse_notes(R.extract_notes(rows).withColumnRenamed("url", "access_key"))


def test_scan_and_register(spark):
    scans = R.scanned(spark.createDataFrame([(f"\thttp://x/?p={K[1]}|2 \n",), (f"http://y/{K[1]}",), (f"http://z/{K[2]}9",), ("no key",), (None,)], "qr_text string"))
    assert sorted(map(str, [r.access_key for r in scans.collect()])) == sorted([K[1], K[1], K[2], "None", "None"])
    registry = spark.createDataFrame([("http://q", K[2], datetime(2024, 1, 1))], "url string, access_key string, read_at timestamp_ntz")
    new = R.register(scans, registry)
    assert [(r.access_key, r.url) for r in new.collect()] == [(K[1], f"http://x/?p={K[1]}|2")]
    assert R.register(scans, registry.unionByName(new)).isEmpty()


def test_listing_lookup_pending(spark):
    rows = [("u", K[3], datetime(2024, 1, 2)), ("u", K[4], datetime(2024, 1, 1)), ("v", K[1], datetime(2024, 1, 3)), ("w", K[1], datetime(2024, 1, 3))]
    registry = spark.createDataFrame(rows, "url string, access_key string, read_at timestamp_ntz")
    assert sorted(map(tuple, R.registry_listing(registry).collect())) == [(1, K[1]), (2, K[1]), (3, K[3]), (4, K[4])]
    notes = spark.createDataFrame([("u",), ("x",)], "url string")
    assert dict(map(tuple, R.key_by_url(notes, registry).collect())) == {"u": K[4], "x": None}
    headers = spark.createDataFrame([(K[1],)], "access_key string")
    assert sorted(r.access_key for r in R.pending_notes(registry, headers).collect()) == [K[3], K[4]]


def test_note_page(spark):
    note = parse(spark, page()).first()
    assert (note.sold_at, note.payment, note.total, note.status) == (datetime(2025, 6, 5, 7, 8, 9), "Dinheiro", 12.5, "saved")
    assert [tuple(i) for i in note["items"]] == [("Café & pão", 2.0, 3.99, 7.98)]


@pytest.mark.parametrize(
    "change,reason",
    [
        ({"total": "1.234,56"}, "total isn't a number"),
        ({"day": "31/02/2025 10:00:00"}, "impossible date"),
        ({"rows": (("a", "1", "1", "1.234,56"),)}, "an item isn't a number"),
        ({"rows": ()}, "missing: items"),
    ],
)
def test_rejected_whole(spark, change, reason):
    notes = parse(spark, page(**change))
    assert (notes.first().status, notes.first().reason) == ("rejected", reason)
    assert R.header_rows(notes).isEmpty() and R.item_rows(notes).isEmpty()


def test_no_emission_is_saved_and_bad_pages_are_rejected(spark):
    notes = {r.access_key: r for r in parse(spark, page(day="soon"), "", None, "<p>not a receipt").collect()}
    assert notes[K[0]].status == "saved" and notes[K[0]].sold_at is None
    assert all(notes[k].reason == "missing: emission" for k in (K[1], K[2], K[3]))


def test_places_without_position_mean_any(spark):
    """Items of all bodies and tables; a section that isn't the first of its name; the first total of several."""
    one, two = ROW.format("a", "1", "2", "2"), ROW.format("b", "3", "4", "12")
    whole = PAGE.format(rows=f"{one}</tbody><tbody>{two}", total="14", payment="x", day="05/06/2025 07:08:09")
    tables = PAGE.format(rows=f"{one}</tbody></table><table><tbody>{two}", total="14</span><span>15", payment="x", day="05/06/2025 07:08:09")
    shifted = whole.replace("<div>c</div><div><div>", "<div>c</div><div><div></div><div>")
    for note in parse(spark, whole, tables, shifted).collect():
        assert note.status == "saved" and note.total == 14.0 and [i["product"] for i in note["items"]] == ["a", "b"]


def test_deep_pages(spark):
    deep = "<b>" * 20_000 + "7" + "</b>" * 20_000
    assert parse(spark, page(total=deep)).first().total == 7.0


def test_upserts_are_idempotent(spark):
    notes = parse(spark, page(rows=(("a", "1", "2", "2"), ("a", "1", "2", "2"))), page(total="9"))
    old = spark.createDataFrame([(K[0], None, "old", 1.0), (K[5], None, "kept", 2.0)], "access_key string, sold_at timestamp_ntz, payment string, total double")
    once = R.upsert_headers(old, notes)
    assert sorted((r.access_key, r.total) for r in once.collect()) == [(K[0], 12.5), (K[1], 9.0), (K[5], 2.0)]
    assert sorted(map(tuple, R.upsert_headers(once, notes).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    items = R.item_rows(notes)
    assert sorted((r.access_key, r.line_no) for r in items.collect()) == [(K[0], 1), (K[0], 2), (K[1], 1)]
    assert R.upsert_items(items, notes).count() == 3


def page_of(rng):
    """A receipt page with something odd in it."""
    item = lambda i: f"<tr><td><span>P{i} &amp; x</span><span>a</span><span>Qtde.:{i}</span><span>b</span><SPAN class='c'>Vl. Unit.: {i},50</span></td><td><span>{i},50</span></td></tr>"
    odd = ["", "<br>", "<br/>", "<!-- <div> -->", "<script>if (a < b) { x('</div>') }</script>", "a < b", "&lt;&#233;&nbsp;", "</p>", "<p>", "<img src='a>b'>", "<div/>", "<b><i>x</b></i>", "<style>td > span {}</style>", "<a href=x/y>z</a>"]
    bad = ["<div", "<!--", "<?x?>", "<a b='c>", "</ div>", "<title>a<b>c</title>", "<div a=b'c'>", "<![CDATA[x]]>", "<textarea><div></textarea>", "<!-->", "<script>", "<svg><p></svg>"]
    o = lambda: rng.choice(bad) if rng.random() < 0.03 else rng.choice(odd) if rng.random() < 0.25 else ""
    items = "".join(o() + item(i) for i in range(rng.randrange(4)))
    body = f"""<div>{o()}<div></div><div></div>{o()}<div></div><div>{o()}<div>1</div><div>{o()}<div><div></div><table><tbody>{items}{o()}</tbody></table>
      <div></div>{o()}<div>{o()}<div></div><div><span> 12,00{o()} </span></div><div></div><div><label>Dinheiro {o()}</label></div></div></div>
      <div><div>{o()}<div><ul><li>Série{o()}</li><li>x</li></ul></div></div></div></div></div></div>"""
    return rng.choice([f"<html><head><title>t</title></head><body>{body}</body></html>", f"<body>{body}</body>", body, f"<!DOCTYPE html>\n<HTML><body class=\"a\">{body}", body[: rng.randrange(len(body))]])


def test_scan_gives_what_the_tree_gives():
    import random

    rng, trusted = random.Random(3), 0
    for _ in range(3000):
        page = page_of(rng)
        assert R.scanned_fields(page) == R.note_fields(page), page
        try:
            R.scan(page, [])
            trusted += 1
        except R.Doubt:
            pass
    assert trusted > 1500
    for page in (None, "", "x", "<", "<div", "a<b"):
        assert R.scanned_fields(page) == R.note_fields(page)


def test_scan_keeps_no_tree():
    """A page of 4 MB: what the scan holds doesn't grow with the page."""
    import tracemalloc

    receipt = "<html><body>" + "<div>x<p>y</p></div>" * 200_000 + "</body></html>"
    tracemalloc.start()
    assert R.scan(receipt, [("html", 1), ("body", 1)])[0]
    assert tracemalloc.get_traced_memory()[1] < 500_000
    tracemalloc.stop()


def test_remembered_ways_give_what_the_tree_gives(monkeypatch):
    """Pages are read along the ways of others, also where few are remembered."""
    import random

    rng = random.Random(5)
    pages = [page_of(rng) for _ in range(2000)] + ["<div>" * 300 + "x", "".join(f"<x{i}>" for i in range(300)), "".join(f"<br id={i}>" for i in range(300)), "<html><body>" + "<p></p>" * 300_000]
    for most in (20_000, 50):
        monkeypatch.setattr(R, "REMEMBERED", most)
        spots, plain = R.Spots(), 0
        for p in pages:
            found = spots.fields(p)
            plain += found is not None
            assert found in (None, R.note_fields(p) if len(p) < 10_000 else None), p
        assert plain > 300 and spots.ways <= most + 1


def test_notes_are_parsed_once(spark):
    """Filters on the outcome don't repeat the parsing: each text is cast once in the plan, and pages are read once."""
    pages = spark.createDataFrame([(K[0], page(total="1e999"))] + [(K[i], page()) for i in range(1, 4)], "url string, html string")
    items = R.item_rows(R.parse_notes(R.extract_notes(pages).withColumnRenamed("url", "access_key")))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("PythonUDF") <= 1 and plan.count("transform(") == 2
    assert sorted((r.access_key, r.line_no, r.quantity) for r in items.collect()) == [(K[i], 1, 2.0) for i in range(1, 4)]
    table = spark.createDataFrame([(x,) for x in (0.0, -0.0, 0.005, 0.01, 1.005, 2.675, 12345678.125, 999999999999999.0, 1e15, 1e300, -3.5, float("nan"), float("inf"), None)], "x double")
    from pyspark.sql import functions as F

    from millrace.plans.catalogue import comma_money

    assert all(a == b for a, b in table.select(comma_money("x"), F.replace(F.format_string("%.2f", "x"), F.lit("."), F.lit(","))).collect())
