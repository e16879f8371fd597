import random

import numpy as np
import pytest

from tidemark.llm import residue
from tidemark.llm.residue import fingerprints, residue_documents, shingles, units
from tidemark.llm.residue_rules import NONE, SPREADS, STAYS, trusted
from tidemark.llm.words import mixed, words

def label(text):
    return max((trusted(s, t) for s, t in units(text)), default=NONE)


OPEN = [
    "Please enable JavaScript to view this page.", "You need to have JavaScript switched on in order to use this application.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Veuillez activer JavaScript pour afficher cette page.",
    "Su navegador tiene los scripts desactivados y esta aplicación no puede cargarse.", "Heads up – This chart needs a browser that runs scripts.", "The report you asked for is overloaded, error 17.", "This application has been removed or renamed.", "Title goes here",
    "TODO: write intro", "asdf asdf qwer asdf", "text text text text text", "xxxx xxxx xxxx xxxx", "Überschrift hier eingeben", "Escriba aquí el resumen del artículo.", "Lead paragraph: to be written", "KeyError: 'summary'", "Sector: choose one",
]
#: Known only to the graph.
KNOWN = [
    "404 Not Found", "HTTP ERROR 503", "Error 500: internal server error.", "Access denied.", "Oops!", "Database connection failed.", "Wartungsarbeiten: Dieser Dienst ist zurzeit nicht erreichbar.", "Page introuvable.", "Lorem ipsum dolor sit amet", "Your content here.",
    "TBD", "N/A", "(no image)", "Titre de la section", "to be written", "Traceback (most recent call last):", "429 Too Many Requests", "Too many requests", "405 Method Not Allowed", "501 Not Implemented", "402 Payment Required", "Connection lost.", "Please wait...", "To be provided",
    "This section is under construction", "No se pudo cargar la página.", "El servidor está fuera de servicio", "Trop de requêtes", "Your address was blocked after 178 requests.", "<html><head><title>504 Gateway Timeout</title></head><body><h1>Gateway Timeout</h1><hr>edge-20</body></html>",
]
SLOTS = ["Page {0} was viewed {1} times since {0}.", "Welcome back, %s!", "Rank NaN of undefined in sector undefined.", "The index of [insert company] stands at 4.", "Dear {{ name }}, your page was edited on {{ date }}.", "Figures for ###DATE### are late.", "<?php echo $x; ?>", "[[PLACEHOLDER]]"]
CONTENT = [
    "Designers have used lorem ipsum since the days of hot metal, as the article explains at some length.", 'The error message "page not found" was the subject of a court case that lasted 12 months.', "In the manual, ${HOME} stands for the directory of the user, and %s for any string.",
    "As the site works without scripts, 31 libraries have put it on their old terminals.", "The JavaScript framework of Vormo Labs was rewritten in 14 weeks and is now used by three banks.", "She marked the gap with TODO and TBD in the margin, a habit that her successors kept up.",
    "A gateway timeout stopped the import for 9 minutes; the missing hours were loaded the next day.", "The placeholder image was replaced on 40 pages, and the complaint about it was withdrawn.", "Editors are asked to put {{infobox company}} at the top of a new article.", "Home | Search | Log in", "yes", "—",
    "The server of the mill is overloaded on Mondays, says the yearly report, and a second one was ordered.",
]


@pytest.mark.parametrize("text", OPEN)
def test_open_forms(text):
    assert label(text) == SPREADS


def test_copies_of_known_texts(spark):
    assert all(label(t) == NONE for t in KNOWN)
    forms = [f for t in KNOWN for f in (t, f"The tram ran 34 times a day.\n  * {t.upper()}\nHome | Search")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*forms, *CONTENT])], "doc_id long, text string")
    got = {r.doc_id: r.step for r in residue_documents(docs).collect()}
    assert got == dict.fromkeys(range(len(forms)), 1)


def test_seeds_spread_in_rounds(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("bcdfgklmnprstvz", k=7))
    chain = [[word() for _ in range(60)]]
    for k in range(4):
        chain.append([*chain[-1][: 8 * k + 3], word(), *chain[-1][8 * k + 4 :]])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(chain[1:])] + [(90, " ".join(word() for _ in range(60)))], "doc_id long, text string")
    got = {r.doc_id: r.step for r in residue_documents(docs, seeds=[" ".join(chain[0])]).collect()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    sets, step, front = [shingles(w).tolist() for w in chain], {}, [0]
    for n in range(2, 9):
        front = [i for i in range(1, len(chain)) if i not in step and any(like(sets[i], sets[j]) >= 0.8 for j in front)]
        step |= dict.fromkeys(front, n)
    assert got == {i - 1: n for i, n in step.items()} and len(got) == 4 and max(got.values()) > 2
    assert residue_documents(docs, seeds=[]).collect() == []


@pytest.mark.parametrize("text", SLOTS)
def test_slots(text):
    assert label(text) == STAYS


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert label(text) == NONE


LONG = (
    "Title goes here, it will tell the readers of this archive of tide gauges and harbour lights what they came for so that whoever comes back "
    "in an hour or two will most likely find every table and every chart where it always was near the old lock"
)


def test_labels_spread_along_near_duplicates_only(spark):
    second = LONG.replace("Title goes", "What stands")
    third = second.replace("old lock", "new quay")
    slot = "Views of {{title}} rose by 12 percent between July and October of the year after the crossing was opened again to ships of every size and flag"
    rows = [
        (1, LONG), (2, second), (3, third), (4, "The crossing was opened again to ships of every size and flag in July of that year"), (5, None), (6, ""), (7, "  \n "), (8, slot), (9, slot.replace("{{title}}", "Vormo Bridge")), (10, "x " * 3000),
    ] + [(100 + i, "Some words.\n" + LONG) for i in range(300)]
    df = spark.createDataFrame([(i, t, 0, True) for i, t in rows], "doc_id long, text string, unit int, trusted boolean")
    got = {r.doc_id for r in residue_documents(df).collect()}
    assert got & set(range(11)) == {1, 2, 3, 8, 10}
    assert set(range(100, 400)) <= got


def test_equal_fingerprints_are_majorities_of_shingle_bits():
    texts = ["one", "one two three", "one two three four five", "a b c d e f g h i j k l"]
    listed = [words(t) for t in texts]
    made = fingerprints(listed)
    for t, f in zip(listed, made):
        s = mixed(np.unique(shingles(t)))
        bits = [sum(int(x) >> b & 1 for x in s) * 2 > len(s) for b in range(64)]
        assert int(f) == sum(1 << b for b, on in enumerate(bits) if on)


def test_different_shingles_do_not_depend_on_the_number_of_units(monkeypatch):
    listed = [words(t) for t in ("a b c d e f a b c d e f g", "one two", "x x x x x x x x", "a b c d e f g h i j k l")]
    fast = residue.different(*residue.hashed(listed))
    monkeypatch.setattr(residue, "SPARE_BITS", 1)
    slow = residue.different(*residue.hashed(listed))
    assert all((x == y).all() for x, y in zip(fast, slow)) and fast[1].tolist() == [7, 1, 1, 8]


def test_units_are_sentences():
    assert [u[0] for u in units("One two.  Three!\nFour | five\n\n—\n6.5 percent of it. " + "Seven eight nine ten eleven twelve.")] == ["One two.", "Three!", "Four | five", "6.5 percent of it.", "Seven eight nine ten eleven twelve."]


def test_empty_table(spark):
    assert residue_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_near_duplicate_is_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("bcdfgklmnprstvz", k=6))
    rows, apart = [], []
    for i in range(60):
        known = ["title", "goes", "here"] + [word() for _ in range(6 if i % 2 else 61)]
        # 8 of 9 words: 4 of 5 shingles. A word changed in the middle of 64: 55 of 65.
        other = known[1:] if i % 2 else [*known[:30], word(), *known[31:]]
        far = known[2:] if i % 2 else [w if k % 20 else word() for k, w in enumerate(known)]
        rows += [(3 * i, " ".join(known)), (3 * i + 1, " ".join(other)), (3 * i + 2, " ".join(far))]
        apart.append(3 * i + 2)
    got = {r.doc_id for r in residue_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    sets = {i: shingles(words(t)).tolist() for i, t in rows}
    wanted = {i for i, _ in rows if i % 3 == 0}
    while more := {i for i in sets if i not in wanted and any(like(sets[i], sets[j]) >= 0.8 for j in wanted)}:
        wanted |= more
    assert got == wanted
    assert {i for i in sets if i % 3 == 1} <= got
