import random
import re

import pytest

from tidemark.llm import residue_rules as rules
from tidemark.llm.words import words

_p = rules._parser
OF_CATEGORY = {_p.CATEGORY_DIGIT: "4", _p.CATEGORY_WORD: "v", _p.CATEGORY_SPACE: " ", _p.CATEGORY_NOT_WORD: "."}
#: Longer than a segment could once be: 24 words for a notice, 60 for the rest, up to 160 characters behind an error's name.
LONG = [
    "This page draws its charts with JavaScript, and as your browser has it switched off or blocked by an extension, please enable it for this site and load the page again.",
    "Bitte aktivieren Sie JavaScript in den Einstellungen Ihres Browsers, da diese Seite ihre Karten, Tabellen und Verläufe erst auf Ihrem Gerät zeichnet und ohne Skripte nur eine leere Fläche zu sehen ist.",
    "Traceback (most recent call last): " + 'File "/srv/app/tide.py", line 40, in load rows = fetch(path, limit) ' * 8 + "KeyError: 'summary'",
    "java.lang.IllegalStateException: " + "at org.tide.Gauge.read(Gauge.java:41) " * 12,
    "Uncaught TypeError: " + "at render (chart.js:12) " * 20,
]
LONG_CONTENT = [
    "The harbour office rewrote its tables in JavaScript over two winters, and as every reader had asked for it, the page with the yearly heights of the old lock was the first one to be drawn on the device of the visitor.",
    "A list of errors that the gauge has made since the storm is kept in the tower, where the keeper notes the hour, the height and the wind, and where a second keeper, who comes at noon, reads them aloud to whoever asks for them, so that none is lost in the years between one great flood and the next, as has happened before.",
]


@pytest.mark.parametrize("text", LONG)
def test_length_alone_takes_no_label(text):
    assert rules.trusted(text, words(text)) == rules.SPREADS


@pytest.mark.parametrize("text", LONG_CONTENT)
def test_long_content(text):
    assert rules.trusted(text, words(text)) == rules.NONE


def sample(parsed, rng, groups):
    """A text made by walking a parsed rule."""
    out = ""
    for op, arg in parsed:
        if op is _p.LITERAL:
            out += chr(arg)
        elif op is _p.ANY:
            out += rng.choice(" v")
        elif op is _p.IN and arg[0][0] is _p.NEGATE:
            out += "v"
        elif op is _p.IN:
            kind, value = rng.choice(arg)
            out += OF_CATEGORY[value] if kind is _p.CATEGORY else chr(value if kind is _p.LITERAL else value[0])
        elif op is _p.BRANCH:
            out += sample(rng.choice(arg[1]), rng, groups)
        elif op is _p.SUBPATTERN:
            out += (made := sample(arg[-1], rng, groups))
            groups[arg[0]] = made
        elif op in (_p.MAX_REPEAT, _p.MIN_REPEAT):
            for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))):
                out += sample(arg[2], rng, groups)
        elif op is _p.GROUPREF:
            out += groups[arg]
        else:
            assert op is _p.AT, op
    return out


@pytest.mark.parametrize("rule", [*rules._FILLER, *rules._ERROR])
def test_texts_of_every_rule_are_trusted(rule):
    rng, parsed, made = random.Random(rule), _p.parse(rule, rules._I.value), 0
    for _ in range(1000):
        text = sample(parsed, rng, {}).strip()
        if text and re.match(rule, text, rules._I) and not rules._LEAD.match(text) and not rules.ABOUT.search(text) and words(text):
            made += 1
            assert rules.trusted(text, words(text)), text
    assert made
