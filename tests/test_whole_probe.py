"""generated_probe on pages of every size, against plain Python."""

from tessera.plans import catalogue


def verdict(html):
    size = len(html.encode())
    probe = html.replace("</p>", "\n").replace("<li>", "\n").encode()[:65536]
    lengths = sorted(map(len, probe.split(b"\n")[:-1]))
    return size >= 16384 and (len(lengths) < 3 or lengths[len(lengths) // 2] > 1000)


def test_large_pages_get_a_verdict(spark, tmp_path):
    long, short = "é" * 1500 + "</p>", "word " * 10 + "<li>"
    pages = ["", short, short * 400, long * 6, short * 3000, long * 50, "x" * 200_000, short * 1400 + long * 60, long * 30 + short * 5000]
    assert sum(len(p.encode()) > 65536 for p in pages) == 5
    rows = [(k, p) for k, p in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.generated for r in catalogue.QUERIES["generated_probe"](spark, str(tmp_path)).collect()}
    assert got == {k: verdict(p) for k, p in rows}
    assert {got[k] for k in range(4, 9)} == {True, False}
