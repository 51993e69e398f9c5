"""The plans end to end on a small invented catalogue, and on a real one if its folder is named."""

import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import catalogue
from shelfmark.operators import graph
from shelfmark.plans import catalogue as plans
from shelfmark.session import stage
from shelfmark.sources import readers, schemas

TOPICS = {
    "web": "browse pages and crawl sites with a headless browser",
    "db": "query tables in postgres and sqlite databases",
    "img": "paint pictures and render drawings from a caption",
}
DAY = datetime.date(2026, 1, 1)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("catalogue")
    for folder in ("packages", "listing", "repositories"):
        (root / folder).mkdir()
    listed, number = [], 0
    for topic, prose in TOPICS.items():
        for i in range(8):
            number += 1
            name = f"@s{i}/pi-{topic}-{i}" if i % 2 else f"pi-{topic}-{i}"
            package = {
                "name": name, "latest_version": "1.0.0", "description": f"{prose} helper{i}",
                "readme": f"# {name}\n\n{prose}. Forked from elsewhere\n\nsee pi-web-2" if i == 3 else f"{prose} again {topic}",
                "keywords": ["pi-package", "pi-skill" if i % 2 else "other", topic],
                "author": {"name": f"Author {i}"} if i % 3 else "Plain",
                "repository": {"type": "git", "url": f"git+https://github.com/o{i}/{topic}.git"} if i % 2 else None,
                "time": {"created": "2026-01-01T00:00:00Z", "modified": "2026-02-01T00:00:00Z"},
                "versions_count": 1, "downloads_last_week": 100 * i if i else None, "download_trend": [],
            }
            (root / "packages" / f"{number}.json").write_text(json.dumps(package))
            listed.append({"name": name, "publisher": "GitHub Actions" if i == 2 else f"pub{i}", "date": "2026-01-01T00:00:00Z", "version": "1"})
            if i in (1, 3):
                repo = {
                    "stargazers_count": 10 * i, "forks_count": i, "open_issues_count": 1, "watchers_count": 2,
                    "fork": i == 3, "pushed_at": "2026-01-05T00:00:00Z",
                    "parent": {"full_name": "up/stream", "html_url": "https://github.com/up/stream"} if i == 3 else None,
                }
                (root / "repositories" / f"o{i}__{topic}.json").write_text(json.dumps(repo))
    (root / "listing" / "packages.json").write_text(json.dumps(listed))
    packages = readers.read_packages(spark, str(root / "packages"))
    daily = [
        (f"pi-web-{i}", DAY + datetime.timedelta(days=d), 1 + d // 30) for i in (0, 2) for d in range(70)
    ]
    weekly = plans.weekly_downloads(spark.createDataFrame(daily, schemas.DAILY_DOWNLOADS))
    full = stage(plans.with_trends(packages, weekly), "packages")
    repositories = readers.read_repositories(spark, str(root / "repositories"))
    listing = readers.read_listing(spark, str(root / "listing"))
    return full, stage(plans.records(full, listing, repositories), "records"), repositories


def test_records(landed):
    rows = {r.name: r for r in landed[1].select("name", "type", "best_author", "stars", "publisher", "slug").collect()}
    assert len(rows) == 24
    assert rows["@s3/pi-web-3"].best_author == "o3" and rows["@s3/pi-web-3"].stars == 30
    assert rows["@s3/pi-web-3"].type == "skill" and rows["pi-web-2"].type == "unknown"
    assert rows["pi-web-2"].best_author == "Author 2" and rows["pi-web-4"].best_author == "pub4"


def test_report(landed):
    tables = plans.report(landed[1], F.lit("2026-06-01").cast("timestamp"))
    counts = {r.type: r.n for r in tables["types"].collect()}
    assert counts == {"skill": 12, "unknown": 12}
    assert tables["top_downloads"].first()["downloads_last_week"] == 700
    assert tables["weekly_totals"].count() == 10
    assert [(r.trajectory, r.n) for r in tables["trajectories"].collect()] == [("growing", 2)]
    assert {r.days for r in tables["stalest"].collect()} == {147}
    assert tables["coverage"].first().asDict() == {"rows": 24, "with_repository": 6, "with_downloads": 21}
    for name, table in tables.items():
        assert table.count() > 0, name
    assert plans.top_trajectories(landed[1], n=3).count() == 0
    grid = plans.top_trajectories(landed[1], n=24)
    assert {r.name for r in grid.select("name").distinct().collect()} == {"pi-web-2"}


def test_near_duplicates(landed):
    pairs = plans.near_duplicates(landed[0]).collect()
    topic = lambda name: name.split("pi-")[-1].split("-")[0]
    assert pairs and all(topic(r.id_a) == topic(r.id_b) for r in pairs if r.score > 0.6)
    assert [r.score for r in pairs] == sorted((r.score for r in pairs), reverse=True)
    assert plans.same_text_packages(landed[0]).count() == 0


def test_serving_and_full_records(landed):
    packages, recs, _ = landed
    found = plans.similarity_graph(packages)
    served = {r.n: r for r in plans.serving(recs, found).collect()}
    assert len(served) == 24
    row = served["pi-web-2"]
    assert row.tt == "growing" and len(row.tr) == 10 and row.kw == ["other", "web"] and row.dt.month == 2
    assert served["@s3/pi-web-3"].fk is True and served["pi-web-0"].dl is None
    assert all(len(r.si) <= 20 and all(0.15 < s.score <= 1 for s in r.si) for r in served.values())
    assert all(r.n not in {s.name for s in r.si} for r in served.values())
    assert all(-1 <= r.x <= 1 and -1 <= r.y <= 1 for r in served.values())
    full = plans.full_records(packages, recs, found)
    assert full.count() == 24 and {"github", "similar"} <= set(full.columns)
    assert plans.word_frequencies(packages).filter("word = 'browse'").first()["docs"] == 8


def test_vector_clusters(spark, landed):
    rng = np.random.default_rng(0)
    rows = [
        (r.name, [float(x) for x in rng.normal(0, 0.02, 3) + np.eye(3)[list(TOPICS).index(r.keywords[-1])]])
        for r in landed[0].select("name", "keywords").collect()
    ]
    vectors = spark.createDataFrame(rows, schemas.EMBEDDING)
    found = plans.vector_clusters(landed[0], vectors, k=3, restarts=2)
    assert found.labels.filter("cluster >= 0").groupBy("cluster").count().filter("count = 8").count() == 3
    assert found.labels.filter("cluster_name is null").count() == 0
    assert {r.pattern for r in found.meta.collect()} == {"long-tail"}
    assert found.words.count() > 0


def test_text_clusters(landed):
    found = plans.text_clusters(landed[0], k=3, restarts=2)
    assert found["labels"].count() == 24
    assert found["summary"].agg(F.sum("members")).first()[0] == 24


def test_repository_graph(landed):
    forks, references = plans.repository_graph(landed[0], landed[1], landed[2])
    assert {(r.package, r.forked_from) for r in forks.collect()} == {(f"@s3/pi-{t}-3", "up/stream") for t in TOPICS}
    rows = {r.id: r for r in references.collect()}
    assert rows["@s3/pi-db-3"].mentions == ["pi-web-2"]
    assert rows["@s3/pi-db-3"].origin_lines[0].endswith("Forked from elsewhere")


@pytest.fixture(scope="module")
def real(spark):
    folder = os.environ.get("SHELFMARK_CATALOGUE_DIR")
    if not folder:
        pytest.skip("SHELFMARK_CATALOGUE_DIR names no catalogue")
    packages = stage(readers.read_packages(spark, folder), "real")
    listing = spark.createDataFrame([], schemas.LISTING)
    repositories = spark.createDataFrame([], f"slug string, {schemas.REPOSITORY}")
    return stage(plans.records(packages, listing, repositories), "real-records")


def test_known_numbers(real):
    assert {r.type: r["count"] for r in real.groupBy("type").count().collect()} == {
        "unknown": 341, "extension": 123, "skill": 13, "theme": 12,
    }
    row = real.agg(
        F.count("downloads_last_week"), F.sum("downloads_last_week"), F.max("downloads_last_week"),
        F.count("slug"), F.count("best_author"),
    ).first()
    assert tuple(row) == (268, 14666, 1057, 330, 392)
    flag = catalogue.serves_several(F.col("keywords"), F.col("description"), F.col("readme"))
    assert real.filter(flag).count() == 22
    assert graph.origin_lines(real, "name", "readme").count() == 30
    mentioned = graph.mentions(real, real, "name", "readme", "name")
    assert (mentioned.count(), mentioned.select("id").distinct().count()) == (112, 63)
