import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, subtitles
from millrace.llm.ppm import Model

WORDS = {
    "en": "the captain stole a letter behind old mill where were you nobody leaves this house tonight we found two tickets",
    "de": "der kapitän stahl einen brief hinter der alten mühle wo warst du niemand verlässt heute dieses haus wir fanden zwei",
    "ru": "капитан украл письмо за старой мельницей где ты был никто не покинет этот дом сегодня мы нашли два билета",
}


def sentences(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return [" ".join(rng.choice(WORDS[lang].split()) for _ in range(7)).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, lang, s) for lang in WORDS for i, s in enumerate(sentences(lang, 40, 1))] + [(1, None, "x"), (2, "en", None)]
    return langid.train(spark.createDataFrame(rows, "sample_id long, lang string, text string"))


def subtitle(parts, eol="\n"):
    return eol.join(f"{k + 1}{eol}00:00:{k:02d},000 --> 00:00:{k:02d},900{eol}{p.replace(chr(10), eol)}{eol}" for k, p in enumerate(parts))


def brute(model, words):
    """Code lengths straight from the definition, with dictionaries."""
    out = []
    for c in model.classes:
        trees = {}
        for w in model_words[c]:
            s = b" " + w + b" "
            for i in range(1, len(s)):
                for k in range(min(i, model.order) + 1):
                    t = trees.setdefault(s[i - k : i], {})
                    t[s[i]] = t.get(s[i], 0) + 1
        import math

        total = 0.0
        s = b" " + words + b" "
        for i in range(1, len(s)):
            p = 1 / 257
            for k in range(min(i, model.order) + 1):
                t = trees.get(s[i - k : i])
                if t:
                    n, d = sum(t.values()), len(t)
                    p = t[s[i]] / (n + d) if s[i] in t else d / (n + d) * p
            total -= math.log2(p)
        out.append(total)
    return out


model_words = {"a": [b"banana", b"band", b"ban"], "b": [b"cabana", b"abba", "äb".encode()]}


def test_code_lengths_are_exact():
    m = Model(["a", "b"], model_words)
    words = [b"banana", b"x", b"", b"bandana", "ä".encode(), b"abbaabbaabba"]
    for w, got in zip(words, m.code_lengths(words)):
        assert got == pytest.approx(brute(m, w), abs=1e-3)


def test_cues():
    text = subtitle(["<i>One</i>", "[DOOR]\nTwo", "{\\an8}1984", "Get it at www.site.example", "(LAUGHS)", "ANNA: Three", "♪ la ♪", ""], "\r\n")
    spoken = [s.strip() for s in subtitles.spoken(text)]
    assert spoken == ["One", "Two", "1984", "", "", "Three", "", ""]
    assert subtitles.cues("no cues at all") == []
    assert subtitles.spoken("1\n00:00:01,000 --> 00:00:02,000") == [""]
    assert subtitles.normal("cafÃ© â™ª &#233;") == "café ♪ é"
    assert subtitles.normal("Ã") == "Ã"


def test_stretches(spark, model):
    en, de, ru = (sentences(x, 30, 2) for x in ("en", "de", "ru"))
    noise = ["[DOOR CREAKS]", "Downloaded from site.example"]
    docs = {
        1: (subtitle(en[:12]), "en"), 2: (subtitle(en[:12]), "German"), 3: (subtitle(de[:8] + en[:6]), "de-AT"), 4: (subtitle(de[:9] + en[:3] + de[9:15]), "Deutsch"),
        5: (subtitle([f"{a}\n{b}" for a, b in zip(en[:7], ru[:7])]), "rus"), 6: (subtitle(ru[:3] + noise + ru[3:5]), None), 7: (subtitle(ru[:4] + noise), ""), 8: (None, "en"), 9: ("", "en"), 10: (subtitle(noise * 5), "??"),
        11: (subtitle([s.upper() for s in de[:6]], "\r\n"), "mul"), 12: (subtitle(["".join(langid.ROMAN.get(c, c) for c in s.lower()) for s in ru[:8]]), "English"), 13: (subtitle(en[:5]) * 200, "en"), 14: (subtitle([s.encode().decode("cp1252", "ignore") for s in de[:9]]), "de"),
    }
    df = spark.createDataFrame([(k, *v, "x") for k, v in docs.items()], "doc long, text string, label string, lang string")
    runs = langid.stretches(df, "doc", "text", model).cache()
    found = langid.mislabelled(df.drop("lang"), runs, "doc", "label")
    assert sorted((r.doc, r.lang) for r in found.collect()) == [(2, "en"), (3, "en"), (5, "en"), (6, "ru"), (11, "de"), (12, "ru")]
    got = sorted((r.doc, r.lang, r.first_cue, r.last_cue, r.cues) for r in runs.where("doc in (3, 4, 6)").collect())
    assert got == [(3, "de", 1, 8, 8), (3, "en", 9, 14, 6), (4, "de", 1, 9, 9), (4, "de", 13, 18, 6), (4, "en", 10, 12, 3), (6, "ru", 1, 7, 5)]
    best = {r.doc: r for r in langid.document_languages(df.drop("lang"), runs, "doc").collect()}
    assert best[8].lang is None and best[10].lang is None and best[4].lang == "de" and best[4].languages == ["de", "en"]
    assert 0.5 < best[1].confidence <= 1
    assert langid.stretches(df.limit(0), "doc", "text", model).count() == 0


def test_held_out_lines(model):
    judge = langid.Judge(model)
    for lang in WORDS:
        lines = sentences(lang, 50, 3)
        text, cls, *_ = judge.stretches([subtitle([s]) for s in lines])
        assert [model.classes[c] for c in cls] == [lang] * 50 and text.tolist() == list(range(50))


def test_labels(spark):
    cases = {
        "en": "en", "EN": "en", "eng": "en", "en-GB": "en", "en_US": "en", "English (US)": "en", "Español": "es", "es_AR": "es", "ger": "de", "Deutsch": "de", "Brazilian Portuguese": "pt", "Русский": "ru", "ru-RU": "ru",
        "Türkçe": "tr", "pt-BR": "pt", "und": None, "mul": None, "": None, None: None, " ": None, "??": None, "n/a": None, "unknown": None, "xx-IT": None, " nl ": "nl",
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in df.select("l", langid.label_code(F.col("l"))).collect()} == cases


def test_every_name_is_one_word():
    assert all(re.fullmatch(r"[^\W\d_]+", w) for names in langid.NAMES.values() for w in names.split())


def test_confidence_is_calibrated():
    """Held-out pieces of the clean samples: stated confidence and share of right answers agree."""
    samples = pq.read_table("/root/testdata/sf0.001/lang_samples.parquet").to_pandas().sort_values("sample_id").reset_index(drop=True)
    rng, sure, right = random.Random(1), [], []
    for fold in range(4):
        train, held = samples[samples.index % 4 != fold], samples[samples.index % 4 == fold]
        words = {}
        for lang, text in zip(train.lang, train.text):
            for spelling in langid.spellings(text):
                words.setdefault(lang, []).extend(w.encode("utf-8", "replace") for w in re.findall(r"\w+", spelling))
        model = langid.Model(sorted(words), words)
        for lang, text in zip(held.lang, held.text):
            parts = re.findall(r"\w+", langid.fold(text))
            n = rng.choice([1, 2, 3, 5])
            at = rng.randrange(max(1, len(parts) - n + 1))
            bits = model.code_lengths([w.encode() for w in parts[at : at + n]]).sum(axis=0)
            weight = np.exp(-(bits - bits.min()) / langid.SOFTNESS)
            sure.append(weight.max() / weight.sum())
            right.append(model.classes[bits.argmin()] == lang)
    sure, right = np.array(sure), np.array(right)
    assert right.mean() > 0.93 and abs(sure.mean() - right.mean()) < 0.03
    assert right[sure >= 0.99].mean() > 0.99 and right[sure < 0.7].mean() < 0.75


def test_models_are_told_apart_by_content(spark):
    a, b = langid.Model(["x", "y"], {"x": [b"aba"], "y": [b"cdc"]}), langid.Model(["x", "y"], {"x": [b"cdc"], "y": [b"aba"]})
    assert a.mark() != b.mark() and a.mark() == langid.Model(["x", "y"], {"x": [b"aba"], "y": [b"cdc"]}).mark()
    docs = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\naba aba aba\n")], "id long, t string")
    assert [langid.stretches(docs, "id", "t", m).first().lang for m in (a, b, a)] == ["x", "y", "x"]


def test_labels_of_other_languages(spark):
    docs = spark.createDataFrame([(1, "fi-FI"), (2, "Finnish"), (3, "fi"), (4, "sv")], "id long, label string")
    runs = spark.createDataFrame([(i, "fi", 9) for i in range(1, 5)], "id long, lang string, cues int")
    assert sorted(r.id for r in langid.mislabelled(docs, runs, "id", "label").collect()) == [2, 4]
    assert sorted(r.id for r in langid.mislabelled(docs, runs, "id", "label", names={"fi": "fi fin finnish", "sv": "sv"}).collect()) == [4]
