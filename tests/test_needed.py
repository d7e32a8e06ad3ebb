"""Words that patterns need, and the flags they get."""

import random
import re

import pytest

from glintmark.functions import constants as K
from glintmark.functions.needed import needed_words, unicode_pattern


@pytest.mark.parametrize("pattern, words", [
    (r"(?i)Controller", ["controller"]), (r"def (post|put)\b", ["def "]), (r"os\.(system|popen)", ["popen", "system"]), (r"ab*c", ["a"]), (r"a?bcd?e", ["bc"]),
    (r"x|", None), (r"[a-z]+\s", None), (r"(?<!SR-)XXX", ["xxx"]), (r"(a|b?)cd", ["cd"]), (r"(?:ab|cd){2,}", ["ab", "cd"]), (r"(?:ab|cd){0,2}", None), (r"x{0}y", ["y"]), (r"[^]a]z\[", ["z["])])
def test_needed_words(pattern, words):
    assert needed_words(pattern) == words


def test_every_match_holds_a_needed_word():
    rng = random.Random(1)
    patterns = [p for p, _ in K.CONTENT_WEIGHTS] + [r[3] for r in K.LINE_RULES]
    bits = ["api_key", "=", " ", "'abcdefghijkl'", "os.", "system", "popen", "getenv", "(x, '", "def ", "post", "put(", "**kwargs", "f(", "SR-", "XXX", "TODO", "session_", "CORS_", "open(", "shutil.move",
            "localhost", "$1.5", "per_token: 3", "except", ":", "from", " .a", "Auth", "eval(", "pickle.load", "@app.route", "[Authorize]", "shell", "True", "time.sleep"]
    seen = 0
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 5)))
        for p in patterns:
            plain = re.sub(r"^\(\?[a-zA-Z]*U\)|(?<=^\(\?i)u?U?", "", p).replace("(?i", "(?i")
            if re.search(plain, text):
                seen += 1
                words = needed_words(p)
                assert words is None or any(w in text.lower() for w in words)
    assert seen > 2000


def test_flags():
    assert unicode_pattern(r"(?i)ab") == "(?iuU)ab" and unicode_pattern(r"a\b") == r"(?U)a\b" and unicode_pattern("ab") == "ab"
