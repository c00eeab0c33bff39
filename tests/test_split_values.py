import pytest

from tablado.operators.split_values import assemble, atoms, delimiter_report, split_values


def pieces(text):
    p = atoms(text)
    return assemble(text, p, [], {x[3] for x in p})


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("Ana", ["Ana"]),
        ("Ana + Eva, Mar y Sol", ["Ana", "Eva", "Mar", "Sol"]),
        ('"Trapo" / \'Vela\' / “Cal”', ["Trapo", "Vela", "Cal"]),
        ('["Nasa", "Ruina, S. A."]', ["Nasa", "Ruina, S. A."]),
        ("D'Arena Tosa + 'Naci'", ["D'Arena Tosa", "Naci"]),
        ('"El ""Otro"" Cuarteto" + Ana', ['El "Otro" Cuarteto', "Ana"]),
        ("['Los \\'X', 'B']", ["Los 'X", "B"]),
        ("(A; B;)", ["A", "B"]),
        ("A\nB\r\nC", ["A", "B", "C"]),
        ("Tó-Bo - C feat. «F»", ["Tó-Bo", "C", "F"]),
        (" + , ", []),
        ('"Perro | Gato', ['"Perro', "Gato"]),
    ],
)
def test_pieces(text, values):
    assert pieces(text) == values


def test_known_names_stay_whole(spark):
    rows = [(1, "s", "Mar & Sol + Ana", "Ana"), (2, "s", "Mar & Luz", "Mar & Sol"), (3, "s", None, "x"), (4, "s", "", "y"), (5, None, "Ana", "z"), (1, "s", "Mar & Sol + Ana", "Ana")]
    df = spark.createDataFrame(rows, "id long, source string, lineup string, artist string").selectExpr("*", "id as item", "id as atoms")
    got = split_values(df, "lineup", "id", source="source", known=df.select("artist")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "Mar & Sol"), (1, 2, "Ana"), (2, 1, "Mar"), (2, 2, "Luz"), (5, 1, "Ana")]
    assert split_values(df.limit(0), "lineup", "id", source="source", known=df.select("artist").limit(0)).count() == 0


def test_long_field(spark):
    df = spark.createDataFrame([(1, "s", " + ".join(f"Ana {i}" for i in range(3000)))], "id long, source string, lineup string")
    assert split_values(df, "lineup", "id", source="source").count() == 3000


def test_delimiters_of_a_source(spark):
    df = spark.createDataFrame([("a", f"Ana {i} + Eva {i}") for i in range(30)] + [("b", f"Una frase larga, con una coma dentro de ella y poco más {i}") for i in range(30)], "source string, lineup string")
    got = {(r.source, r.delimiter): r.score for r in delimiter_report(df, "lineup", source="source").collect()}
    assert got[("a", "+")] > 0.8
