"""Where all texts lie in one table, the rounds don't scan it again."""

from marginalia.sources import discovery


def test_a_table_of_texts_is_scanned_once(spark):
    texts = {"main.tex": "\\input{a}\\input{gone}", "a.tex": "\\input{b}", "b.tex": "\\input{c}\\input{main}", "c.tex": "\\includegraphics{pic}\\input{\\x}", "unread.tex": "\\input{b}\\input{lost}", "pic.png": "\\input{a}"}
    scanned = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("p", f, t) for f, t in texts.items()], "project string, file string, text string")
    listing, mains = rows.select("project", "file"), rows.filter("file = 'main.tex'").select("project", "file")
    sets = lambda p: [{tuple(r) for r in df.collect()} for df in (p.files, p.edges, p.external)]
    got = sets(discovery.discover(mains, listing, rows.mapInArrow(counted, rows.schema)))
    assert scanned.value == len(texts)
    assert got == sets(discovery.discover(mains, listing, lambda asked: rows.join(asked, ["project", "file"], "left_semi")))
    assert ("p", "c.tex", 3) in got[0] and not any("unread.tex" in r for part in got for r in part)
