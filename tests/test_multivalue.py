from __future__ import annotations

from lodework.operators import multivalue as mv

WORDS = mv.Dictionary(
    [("genres", x) for x in ("rock & roll", "crime, true", "action/adventure", "western", "war", "family", "sword and sorcery")]
    + [("production_countries", x) for x in ("korea, republic of", "kenya", "trinidad and tobago", "japan")]
    + [("keywords", x) for x in ("no; never", "cat & mouse", "lighthouse", "strike")]
    + [("production_companies", f"firm{i} {e}") for i in range(10) for e in ("studios", "films", "pictures")]
)


def split(family: str, text: str) -> list[str]:
    return mv.split_cell(family, text, WORDS)


def test_structured_cells():
    assert split("genres", '["War", "Law & Order, Procedural"]') == ["War", "Law & Order, Procedural"]
    assert split("keywords", "['a', \"Côte d'Ivoire\"]") == ["a", "Côte d'Ivoire"]
    assert split("keywords", '[{"id": 1, "name": "C\\u00f4te"}, {"id": 2, "name": "x"}]') == ["Côte", "x"]
    assert split("keywords", "[not json, at all]") == ["[not json", "at all]"]


def test_known_values_keep_their_delimiters():
    assert split("genres", "Rock & Roll;War") == ["Rock & Roll", "War"]
    assert split("genres", "Crime, True\nWestern") == ["Crime, True", "Western"]
    assert split("genres", "War and Family") == ["War", "Family"]
    assert split("genres", "Western, Sword and Sorcery, and War") == ["Western", "Sword and Sorcery", "War"]
    assert split("production_countries", "Korea, Republic of") == ["Korea, Republic of"]
    assert split("production_countries", "Kenya / Japan / Trinidad and Tobago") == ["Kenya", "Japan", "Trinidad and Tobago"]
    assert split("keywords", "no; never | strike") == ["no; never", "strike"]


def test_people_and_firms():
    assert split("cast_names", "Rossi, Anna; Berg, Ole") == ["Rossi, Anna", "Berg, Ole"]
    assert split("cast_names", "Rossi, Anna") == ["Rossi, Anna"]
    assert split("cast_names", "Anna Rossi, Ole Berg & Li Wei") == ["Anna Rossi", "Ole Berg", "Li Wei"]
    assert split("production_companies", "Alder & Birch, Ltd.; Dune Films") == ["Alder & Birch, Ltd.", "Dune Films"]
    assert split("production_companies", "Alder and Sons, Dune, Inc., Elm Studios") == ["Alder and Sons", "Dune, Inc.", "Elm Studios"]
    assert split("production_companies", "Alder Films\nBirch and Sons") == ["Alder Films", "Birch and Sons"]


def test_quotes_nulls_and_blanks():
    assert split("genres", '"Crime, True", War') == ["Crime, True", "War"]
    assert split("genres", "War | N/A |  | Family | -") == ["War", "Family"]
    assert split("genres", '"a ""b"" c";d') == ['a "b" c', "d"]
    assert split("genres", "n/a") == []
    assert split("genres", "War;War") == ["War", "War"]
    assert split("genres", '"unclosed; x') == ["unclosed", "x"]


def test_table_with_odd_rows(spark):
    schema = "record_id long, cells array<struct<column_name:string,cell_value:string>>, item string"
    rows = [
        (1, [("Cast Names", "Anna Rossi; Ole Berg"), ("title", "a; b"), (None, "x;y"), ("genres", None), ("keywords", " ")], "clash"),
        (1, [("genres", "A, B")], None), (None, [("genres", "A|B")], None), (2, None, None), (3, [], None),
        (4, [("keywords", ";".join(f"word {i}" for i in range(5000)))], None),
    ]
    out = mv.split_values(spark.createDataFrame(rows, schema)).collect()
    by = {}
    for r in out:
        by.setdefault((r["record_id"], r["column_name"]), []).append((r["pos"], r["item"]))
    assert sorted(by[(1, "Cast Names")]) == [(0, "Anna Rossi"), (1, "Ole Berg")]
    assert sorted(by[(1, "genres")]) == [(0, "A"), (1, "B")]
    assert len(by[(None, "genres")]) == 2 and len(by[(4, "keywords")]) == 5000
    assert mv.split_values(spark.createDataFrame([], schema)).collect() == []


def test_rare_values_are_matched_like_frequent_ones(spark):
    """With an automaton of one entry, the rest of the dictionary works through the join: same rows."""
    schema = "record_id long, cells array<struct<column_name:string,cell_value:string>>"
    cells = ['["Rock & Roll", "War"]', '["Crime, True"]', '["War"]', "Rock & Roll; War", "Crime, True | War", "War and Family"]
    df = spark.createDataFrame([(i, [("genres", c)]) for i, c in enumerate(cells)], schema)
    key = lambda d: sorted((r["record_id"], r["pos"], r["item"]) for r in d.collect())
    assert key(mv.split_values(df)) == key(mv.split_values(df, entries=1))
    firms = ['["Alpha, Beta, Gamma, Delta & Sons", "Acme Films"]', '["Acme Films", "Foo Pictures", "Acme Films"]', '["Alder Films", "Birch Films", "Cedar Films"]']
    firms += ["Acme Films; Alpha, Beta, Gamma, Delta & Sons; Foo Pictures", "Acme Films, Alpha, Beta, Gamma, Delta & Sons", "Oak and Ash Films", "Acme Films / Dune Films"]
    df = spark.createDataFrame([(i, [("production_companies", c)]) for i, c in enumerate(firms)], schema)
    assert key(mv.split_values(df)) == key(mv.split_values(df, entries=1)) == key(mv.split_values(df, entries=3))
    assert [x[2] for x in key(mv.split_values(df, entries=3)) if x[0] == 3] == ["Acme Films", "Alpha, Beta, Gamma, Delta & Sons", "Foo Pictures"]


def test_columns_are_a_parameter(spark):
    schema = "record_id long, cells array<struct<column_name:string,cell_value:string>>"
    df = spark.createDataFrame([(1, [("Speakers", "Rossi, Anna; Berg, Ole"), ("genres", "War; Family")])], schema)
    assert sorted(r["item"] for r in mv.split_values(df, columns={"speakers": "person"}).collect()) == ["Berg, Ole", "Rossi, Anna"]
