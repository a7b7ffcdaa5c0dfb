import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quire.session import get_spark
    s = get_spark("local[4]", app="quire-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g",
                         "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s


def write_json(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        if isinstance(obj, str):
            f.write(obj)
        else:
            json.dump(obj, f)


def item(label, number, title, **kw):
    d = {"link": label.lower(), "scp": label, "scp_number": number, "title": title, "series": "series-1",
         "url": f"https://wiki.example.org/{label.lower()}", "tags": ["euclid"], "rating": 10,
         "created_at": "2008-07-25T20:49:00Z", "creator": "author1", "raw_source": f"source of {label}",
         "raw_content": f"<div id=\"page-content\"><p>Body of {label}, long enough to be content.</p></div>",
         "images": [], "hubs": ["hub-a"], "references": [],
         "history": [{"author": "ed1", "date": "2010-01-01T00:00:00+02:00", "comment": "first"}]}
    d.update(kw)
    return d


@pytest.fixture(scope="session")
def raw_root(tmp_path_factory):
    """Two snapshots; the newer one has: a null content_file, a label whose
    file is missing, a label missing from its file, a broken file, a
    suffixed item, an invalid item (bad number) and a quoted title."""
    root = tmp_path_factory.mktemp("raw")
    old = os.path.join(root, "scp-1700000000-aaaaaaaaaaaa", "items")
    write_json(os.path.join(old, "index.json"), {"SCP-002": {"content_file": "c1.json"}})
    write_json(os.path.join(old, "c1.json"), {"SCP-002": item("SCP-002", 2, "The Living Room")})
    new = os.path.join(root, "scp-1800000000-bbbbbbbbbbbb", "items")
    write_json(os.path.join(new, "index.json"), {
        "SCP-002": {"content_file": "c1.json"},
        "SCP-173": {"content_file": "c1.json"},
        "SCP-100-J": {"content_file": "c2.json"},
        "SCP-096": {"content_file": "c2.json"},
        "SCP-404": {"content_file": None},
        "SCP-405": {"content_file": "missing.json"},
        "SCP-406": {"content_file": "c2.json"},
        "SCP-500": {"content_file": "broken.json"},
        "SCP-999": {"content_file": "c2.json"},
    })
    write_json(os.path.join(new, "c1.json"), {
        "SCP-002": item("SCP-002", 2, "The Living Room", raw_content="<p>changed room text that is long enough</p>"),
        "SCP-173": item("SCP-173", "SCP-173", "The Sculpture", rating=1234, tags=["euclid", "statue", "hostile"]),
    })
    write_json(os.path.join(new, "c2.json"), {
        "SCP-100-J": item("SCP-100-J", "SCP-100-J", "Joke"),
        "SCP-096": item("SCP-096", 96, 'The "Shy Guy"', rating=987, tags="keter"),
        "SCP-999": item("SCP-999", 999, "The Tickle Monster", rating=None, tags=None, hubs=None),
    })
    write_json(os.path.join(new, "broken.json"), "{not json")
    return str(root)


@pytest.fixture(scope="session")
def staging_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("staging")
    write_json(os.path.join(root, "markdown", "1", "7", "3", "scp-173.md"),
               "---\ntitle: x\n---\n\n# SCP-173\n\nStaged markdown.\n")
    write_json(os.path.join(root, "summary", "1", "7", "3", "scp-173.md"), "---\na: b\n---\nShort summary.")
    write_json(os.path.join(root, "summary", "0", "9", "6", "scp-096.md"), "   ")
    return str(root)
