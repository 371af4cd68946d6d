import csv
import glob
import json

import pandas as pd
import pytest

from zeitton import schemas
from zeitton.sources import articles as article_source
from zeitton.sources import links as link_source

ODD = 'say "hi"\tthen\nnew line \\ back\\"slash; ünï • end '
COLUMNS = [f.name for f in schemas.ARTICLE]


def rows():
    base = {c: f"{c} text" for c in COLUMNS}
    return [
        {**base, "date_api": "2024-01-02", "page_api": 1, "headline": ODD, "articleBody": ODD * 3},
        {**base, "date_api": "2024-01-01", "page_api": 2, "headline": None, "taglist": '["a","b"]'},
        {**base, "date_api": "2024-01-03", "page_api": 3, "headline": " kept ", "short_text": '"'},
    ]


def frame(spark):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows()], schemas.ARTICLE)


def as_dicts(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["page_api"])


def wanted():
    return sorted(rows(), key=lambda r: r["page_api"])


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "articles.csv")
    article_source.save_articles(frame(spark), path)
    assert as_dicts(article_source.read_tsv(spark, path)) == wanted()
    parts = sorted(glob.glob(f"{path}/part-*"))
    read = pd.concat([pd.read_csv(p, sep="\t", keep_default_na=False) for p in parts])
    assert list(read.date_api) == sorted(read.date_api) and list(read.columns) == COLUMNS
    assert set(read.headline) == {ODD, "", " kept "}


def test_tsv_written_by_pandas(spark, tmp_path):
    path = tmp_path / "pandas.csv"
    pd.DataFrame(rows(), columns=COLUMNS).to_csv(path, sep="\t", index=False)
    assert as_dicts(article_source.read_tsv(spark, str(path))) == wanted()
    stored = article_source.to_parquet(spark, str(path), str(tmp_path / "stored"))
    assert as_dicts(stored) == wanted()


def test_parquet_sink_append_and_batches(spark, tmp_path):
    path = str(tmp_path / "articles")
    article_source.save_articles(frame(spark), path)
    article_source.save_articles(frame(spark), path, mode="append")
    assert spark.read.parquet(path).count() == 6
    batches = str(tmp_path / "batches")
    for batch in (0, 1, 1):
        article_source.append_batch(frame(spark), batches, batch)
    assert spark.read.parquet(batches).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 3), (1, 3)]


def test_tsv_nested_empty_and_append(spark, tmp_path):
    nested = spark.createDataFrame([("2024-01-01", ["a", "b"])], "date_api string, taglist array<string>")
    path = str(tmp_path / "nested.csv")
    article_source.write_tsv(nested, path)
    article_source.write_tsv(nested, path, mode="append")
    files = [list(csv.reader(open(p), delimiter="\t")) for p in glob.glob(f"{path}/part-*")]
    assert all(lines[0] == ["date_api", "taglist"] for lines in files)
    assert [row for lines in files for row in lines[1:]] == [["2024-01-01", '["a","b"]']] * 2
    empty = str(tmp_path / "empty.csv")
    article_source.save_articles(frame(spark).limit(0), empty)
    assert article_source.read_tsv(spark, empty).collect() == []


LINES = [
    ('{"link": "/inland/a", "headline": "Zoë • ß", "page_api": 2}', True),
    ('{"link": "http://x/a"}', False),
    ('{"link": ""}', True),
    ('{"headline": "no link"}', False),
    ('{"link": null}', False),
    ('{"link": 5}', False),
    ("{bad", False),
    ("5", False),
    ('[{"link":"/x"}]', False),
    ("", False),
]


def test_links(spark, tmp_path):
    path = tmp_path / "links.json"
    path.write_text("\n".join(line for line, _ in LINES) + "\n", encoding="utf-8")
    got = link_source.read_links(spark, str(path)).collect()
    assert sorted(r.link for r in got) == sorted(json.loads(line)["link"] for line, kept in LINES if kept)
    assert {r.headline for r in got} == {"Zoë • ß", None}
    assert link_source.read_links(spark, str(tmp_path / "missing")).collect() == []


def test_links_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "links")
    listing = frame(spark).select(*[f.name for f in schemas.LISTING])
    link_source.append_links(listing, path)
    link_source.append_links(listing, path)
    back = link_source.read_links(spark, path)
    assert back.columns == listing.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, listing.collect() * 2))
    text = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{path}/part-*"))
    assert "ünï" in text and len(text.strip().split("\n")) == 6


@pytest.mark.parametrize("schema", [schemas.ARTICLE_SENTIMENT, schemas.ARTICLE_POLARITY])
def test_layer_schemas(schema):
    assert len({f.name for f in schema}) == len(schema)


def test_tsv_folder_with_another_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("link\theadline\n/a\tone\n")
    (tmp_path / "b.csv").write_text("headline\tlink\ntwo\t/b\n")
    with pytest.raises(Exception, match="(?i)header"):
        article_source.read_tsv(spark, str(tmp_path)).collect()
