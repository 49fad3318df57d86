"""Context on both sides of a span."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import pii


def test_context_on_both_sides(spark):
    far = "x" * 41
    texts = ["123-45-6789 is my social security number", "SSN: 123-45-6789, 321-54-9876 ssn", f"123-45-6789 {far} ssn", f"ssn {far} 123-45-6789", "é😀 123-45-6789 ssn", "123-45-6789", "321-54-9876 SSN 666-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"], s["score"]) for s in r["spans"]] for r in pii.detect(docs).select("row.doc_id", "spans").collect()}
    assert spans == {0: [(0, 11, 0.7)], 1: [(5, 16, 0.7), (18, 29, 0.7)], 2: [], 3: [], 4: [(3, 14, 0.7)], 5: [], 6: [(0, 11, 0.7)]}


def test_secrets_and_languages(spark):
    key = "0a1b2c3d4e5f60718293"
    texts = [f'token = "{key}"', key, f"API key: {key} {key}z", f"token {key[:-1]}", "token " + "a" * 30, f"Geheimnis {key}", f"contraseña {key}", None, ""]
    texts += [f"{word} 123-45-6789" for word in ("Sozialversicherungsnummer", "numéro de sécurité sociale", "NÚMERO DE SEGURIDAD SOCIAL", "sécurité")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.detect(docs).select("row.doc_id", pii.joined(F.col("spans")).alias("spans"), pii.scored(F.col("spans")).alias("scores")).collect()
    found = {r["doc_id"]: (r["spans"], r["scores"]) for r in rows}
    assert found == {
        0: ("secret:9:29", "0.70"), 1: ("", ""), 2: ("secret:9:29", "0.70"), 3: ("", ""), 4: ("", ""), 5: ("secret:10:30", "0.70"), 6: ("secret:11:31", "0.70"), 7: ("", ""), 8: ("", ""),
        9: ("ssn:26:37", "0.70"), 10: ("ssn:27:38", "0.70"), 11: ("ssn:27:38", "0.70"), 12: ("", ""),
    }
    assert pii.detect(docs.limit(0)).count() == 0
