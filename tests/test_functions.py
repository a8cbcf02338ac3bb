"""Text functions on small cases."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import scalars as sc
from corpusgraph.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,key", [("Año", "año"), ("Corazón", "corazon"), ("ano", "ano"), ("beta-bloqueo", "betabloqueo"), ("ÑANDÚ", "ñandu"), ("Über", "uber")])
def test_term_key(spark, raw, key):
    assert one(spark, tx.term_key(F.col("w")), w=raw) == key


@pytest.mark.parametrize(
    "word,lang,lemma",
    [("hospitales", "es", "hospital"), ("pacientes", "es", "paciente"), ("luces", "es", "luz"), ("evaluaciones", "es", "evaluacion"), ("dosis", "es", "dosis"), ("rapidamente", "es", "rapida"), ("casas", "es", "casa"), ("studies", "en", "study"), ("running", "en", "run"), ("boxes", "en", "box"), ("analysis", "en", "analysis"), ("agreed", "en", "agreed"), ("tested", "en", "test"), ("class", "en", "class"), ("cats", "mixto", "cats"), ("ideas", "mixto", "idea")],
)
def test_lemma(spark, word, lang, lemma):
    assert one(spark, tx.lemma(F.col("w"), F.col("l")), w=word, l=lang) == lemma


def test_sentences(spark):
    text = "El Dr. Pérez vino. La Dra. Ruiz no.  Dijo algo? Sí!\n\nUn título\n\nFin"
    assert one(spark, tx.sentences(F.col("t")), t=text) == ["El Dr. Pérez vino.", "La Dra. Ruiz no. Dijo algo?", "Sí!", "Un título\n\nFin"]
    assert one(spark, tx.sentences(F.col("t")), t="") == []


def test_language(spark):
    es, en = "la casa de los padres es grande y el perro no esta con ellos para que se vea todo lo que hay " * 2, "the house of the parents is big and the dog is not with them so that all of it can be seen there " * 2
    assert one(spark, tx.language(F.col("t")), t=es) == "es"
    assert one(spark, tx.language(F.col("t")), t=en) == "en"
    assert one(spark, tx.language(F.col("t")), t="hola") == "indeterminado"


def test_tokens(spark):
    got = one(spark, tx.tokens(F.col("t"), F.lit("es"), ["perro"]), t="Los hospitales grandes. 1234 perros Árboles-verdes")
    assert [(t.lemma, t.form, t.sentence) for t in got] == [("hospital", "hospitales", 0), ("grand", "grandes", 0), ("arbolesverd", "Árboles-verdes", 1)]


def test_user_stop_words():
    assert tx.parse_stop_words("uno, dos;tres\n\n cuatro ") == ["uno", "dos", "tres", "cuatro"]
    assert "corazon" in tx.stop_set(["Corazón"])


def test_path_terms(spark):
    assert one(spark, tx.path_terms(F.col("p")), p="notas/ensayoClinico_renal-2021.final.md") == ["notas", "ensayo", "clinico", "renal", "final"]


def test_scalars(spark):
    assert one(spark, sc.csv_field(F.col("x")), x='a "b"; c') == '"a ""b""; c"'
    assert one(spark, sc.html_escape(F.col("x")), x="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, sc.joined(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), x=1) == "a, b y c"
    assert one(spark, sc.rounded(F.col("x"), 2), x=0.125) == 0.13
    assert one(spark, sc.byte_size(F.col("x")), x=2048) == "2.0 KB"


def test_numbers_as_texts(spark):
    assert one(spark, sc.plural(F.col("x"), "file"), x=1) == "1 file" and one(spark, sc.plural(F.col("x"), "box", "boxes"), x=1234) == "1,234 boxes"
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 kB", 10_239: "10.0 kB", 10_240: "10 kB", 5 << 30: "5.0 GB", 3 << 50: "3072 TB"}
    assert {n: one(spark, sc.byte_text(F.col("x")), x=n) for n in sizes} == sizes
    took = {0: "0 ms", 999: "999 ms", 1500: "1.50 s", 21_450: "21.4 s", 61_600: "1 min 2 s"}
    assert {n: one(spark, sc.duration(F.col("x")), x=n) for n in took} == took
    assert one(spark, sc.date_text(F.col("x"), tuple("abcdefghijkl")), x=86_400_000 * 32) == "02 b 1970 00:00"
