"""License scan: ordered signature rules.

A rule is a regular expression over the lower-cased words of a text, joined by single
blanks. Rules are written out from the tables ``LICENSES`` and ``SPDX``: for each license its
names, the sentences in which licenses are granted or referred to, and its short identifiers.
The plain part of a name must occur before its rules are tried; the gate, made of the same plain
parts with anything that separates words between them, spares other texts the splitting.

Rules are ordered by priority. A match that lies inside a match of a better rule, or of an
equally good longer one, is suppressed: "GNU Lesser General Public License" is not a GPL.
What remains gives the labels. The base phrases are found word by word and always count.

All of it is DataFrame expressions on one row at a time, without a shuffle. Defined
results: a null or empty text has no words and no labels; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored. Words and
positions count from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import let, text_of

# --- Fixed values: the base phrases and their labels. ---
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# --- End of fixed values. ---

# label, names as regular expressions over words.
LICENSES = [
    ("mit", ["mit license", "mit licen[sc]ed", "expat license", "x11 license"]),
    ("apache", ["apache license", "apache software license"]),
    ("lgpl", ["gnu lesser general public license", "lesser general public license", "gnu library general public license"]),
    ("agpl", ["gnu affero general public license", "affero general public license"]),
    ("gpl", ["gnu general public license", "general public license", "gnu gpl"]),
    ("fdl", ["gnu free documentation license", "free documentation license"]),
    ("bsd", ["bsd license", "[234] clause bsd license", "bsd [234] clause license", "bsd style license", "new bsd license", "simplified bsd license"]),
    ("mpl", ["mozilla public license"]),
    ("epl", ["eclipse public license", "eclipse distribution license"]),
    ("cddl", ["common development and distribution license"]),
    ("cpl", ["common public license"]),
    ("isc", ["isc license", "internet systems consortium license"]),
    ("zlib", ["zlib license", "zlib libpng license"]),
    ("boost", ["boost software license"]),
    ("unlicense", ["unlicense", "unlicensed license"]),
    ("wtfpl", ["wtfpl"]),
    ("artistic", ["artistic license", "perl artistic license"]),
    ("python", ["python software foundation license", "psf license", "python license"]),
    ("ruby", ["ruby license"]),
    ("php", ["php license"]),
    ("postgresql", ["postgresql license"]),
    ("openssl", ["openssl license", "openssl ssleay license"]),
    ("ofl", ["sil open font license", "open font license"]),
    ("eupl", ["european union public license", "european union public licence"]),
    ("ms-pl", ["microsoft public license"]),
    ("ms-rl", ["microsoft reciprocal license"]),
    ("apsl", ["apple public source license"]),
    ("ibm-pl", ["ibm public license"]),
    ("lppl", ["latex project public license"]),
    ("afl", ["academic free license"]),
    ("osl", ["open software license"]),
    ("ncsa", ["ncsa open source license", "university of illinois ncsa open source license"]),
    ("upl", ["universal permissive license"]),
    ("mulan", ["mulan permissive software license", "mulan psl"]),
    ("bsl", ["business source license"]),
    ("sspl", ["server side public license"]),
    ("elastic", ["elastic license"]),
    ("commons-clause", ["commons clause license", "commons clause"]),
    ("odbl", ["open database license"]),
    ("odc-by", ["open data commons attribution license"]),
    ("pddl", ["public domain dedication and license"]),
    ("cc0", ["cc0", "creative commons zero", "cc zero"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivs", "creative commons attribution noncommercial noderivatives"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivs", "creative commons attribution noderivatives"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"]),
    ("cc-by", ["cc by", "creative commons attribution"]),
    ("openrail", ["creativeml openrail m license", "bigscience openrail m license", "openrail license"]),
    ("proprietary", ["all rights reserved"]),
]

# label, short identifiers without their version, as regular expressions over words.
SPDX = [
    ("mit", ["mit", "x11"]), ("apache", ["apache"]), ("lgpl", ["lgpl"]), ("agpl", ["agpl"]), ("gpl", ["gpl"]), ("fdl", ["gfdl"]),
    ("bsd", ["0bsd", "bsd [1234] clause"]), ("mpl", ["mpl"]), ("epl", ["epl"]), ("cddl", ["cddl"]), ("cpl", ["cpl"]),
    ("isc", ["isc"]), ("zlib", ["zlib"]), ("boost", ["bsl"]), ("unlicense", ["unlicense"]), ("wtfpl", ["wtfpl"]),
    ("artistic", ["artistic"]), ("python", ["python", "psf"]), ("ruby", ["ruby"]), ("php", ["php"]),
    ("postgresql", ["postgresql"]), ("openssl", ["openssl"]), ("ofl", ["ofl"]), ("eupl", ["eupl"]), ("ms-pl", ["ms pl"]),
    ("ms-rl", ["ms rl"]), ("apsl", ["apsl"]), ("ibm-pl", ["ipl"]), ("lppl", ["lppl"]), ("afl", ["afl"]), ("osl", ["osl"]),
    ("ncsa", ["ncsa"]), ("upl", ["upl"]), ("mulan", ["mulanpsl"]), ("bsl", ["busl"]), ("sspl", ["sspl"]),
    ("elastic", ["elastic"]), ("odbl", ["odbl"]), ("odc-by", ["odc by"]), ("pddl", ["pddl"]), ("cc0", ["cc0"]),
    ("cc-by-nc-nd", ["cc by nc nd"]), ("cc-by-nc-sa", ["cc by nc sa"]), ("cc-by-nc", ["cc by nc"]), ("cc-by-nd", ["cc by nd"]),
    ("cc-by-sa", ["cc by sa"]), ("cc-by", ["cc by"]),
]

_VERSION = r"(?: (?:international|unported))?(?: (?:version|v|ver))? ?[0-9]+(?: [0-9]+){0,2}(?: (?:only|or later|or any later version))?"
# priority (smaller is better), confidence, frame around the name.
FRAMES = [
    (0, 1.0, r"(?:is |are |be |re)?(?:licen[sc]ed|released|distributed|available|published) (?:to you )?under (?:the )?(?:terms of )?(?:the )?{name}{version}"),
    (1, 0.95, r"(?:is |are |be |re)?(?:licen[sc]ed|released|distributed|available|published) (?:to you )?under (?:the )?(?:terms of )?(?:the )?{name}"),
    (2, 0.9, r"spdx license identifier {name}(?:{version})?"),
    (3, 0.8, r"{name}{version}"),
    (4, 0.6, r"(?:see|read|accept|copy of) the {name}"),
    (5, 0.5, r"{name}"),
]
def keyword(name: str) -> str:
    """The longest plain part of a name: a text without it cannot match."""
    return max(re.findall(r"[a-z0-9 ]+", name), key=len).strip()


def rules() -> list[tuple[str, str, int, float, str]]:
    """``(label, keyword, priority, confidence, pattern)``, a few hundred."""
    tag = "spdx license identifier"
    short = [
        (label, tag, 2, 0.9, rf"(?<= ){tag} {name}(?:{_VERSION})?(?= )") for label, names in SPDX for name in names
    ]
    return short + [
        (label, keyword(name), priority, confidence, rf"(?<= ){frame.format(name=name, version=_VERSION)}(?= )")
        for priority, confidence, frame in FRAMES
        for label, names in LICENSES
        for name in names
    ]


SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def gate() -> str:
    """A text that any rule or base phrase matches has one of these, whatever stands between its words."""
    # Nearly all keywords hold a part of "license"; of the others the shortest stand for those that hold them.
    plain = {"licen" if "licen" in k else k for k in [*(r[1] for r in rules()), *BASE]}
    least = sorted(k for k in plain if not any(o != k and o in k for o in plain))
    return "(?i)" + "|".join(k.replace(" ", SEPARATORS) for k in least)


def _rule_array() -> Column:
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cells = ", ".join(
        f"named_struct('label', {quote(a)}, 'keyword', {quote(b)}, 'priority', {c}, 'confidence', {d}D, 'pattern', {quote(e)})"
        for a, b, c, d, e in rules()
    )
    return F.expr(f"array({cells})")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words in a text whose capitals are still there.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
CAPITALS = "".join(map(chr, range(65, 91)))


def license_words(text: Column) -> Column:
    low = F.translate(text, CAPITALS, CAPITALS.lower())
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _places(words: Column) -> Column:
    """Base places as ``(at, label)``, in order."""

    def at(phrase: str, label: str) -> Column:
        parts = phrase.split()
        here = lambda i: [F.get(words, i + k) == p for k, p in enumerate(parts)]
        fits = lambda i: here(i)[0] & here(i)[1] & (here(i)[2] if len(parts) > 2 else F.lit(True))
        starts = F.filter(F.transform(words, lambda w, i: F.when((w == parts[0]) & fits(i), i)), lambda i: i.isNotNull())
        return F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

    return F.sort_array(F.concat(*[at(p, label) for p, label in BASE.items()]))


def _matches(joined: Column) -> Column:
    """``(start, end, priority, label, confidence)`` of every rule whose keyword occurs."""
    tried = F.filter(_rule_array(), lambda r: F.contains(joined, F.concat(F.lit(" "), r["keyword"])))

    def of(r: Column) -> Column:
        hits = F.regexp_extract_all(joined, r["pattern"], F.lit(0))

        def placed(h: Column) -> Column:
            pieces = F.call_function("split", joined, r["pattern"], F.lit(-1))

            def spans(g: Column) -> Column:
                # Few matches of one rule stand in a text; their starts are sums of lengths.
                steps = F.transform(h, lambda x, i: F.length(x) + F.length(g[i]))
                return F.transform(
                    h,
                    lambda x, i: let(
                        F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0), lambda a, y: a + y) + F.length(g[i]),
                        lambda s: F.struct(
                            s.alias("start"), (s + F.length(x)).alias("end"), r["priority"].alias("priority"),
                            r["label"].alias("label"), r["confidence"].alias("confidence"),
                        ),
                    ),
                )

            return let(pieces, spans)

        return F.when(F.regexp_like(joined, r["pattern"]), let(hits, placed)).otherwise(
            F.array().cast("array<struct<start: int, end: int, priority: int, label: string, confidence: double>>")
        )

    return F.flatten(F.transform(tried, of))


def _unsuppressed(matches: Column) -> Column:
    """Matches that lie inside no better one.

    In the order of start (longest first) the running furthest end of the better rules
    tells whether a match is inside one, so no pair is compared.
    """
    # At equal starts the longer match comes first.
    ordered = F.sort_array(
        F.transform(
            matches,
            lambda m: F.struct(
                m["start"].alias("start"), (-m["end"]).alias("back"), m["priority"].alias("priority"),
                m["label"].alias("label"), m["confidence"].alias("confidence"),
            ),
        )
    )
    n = len(FRAMES)
    element = "struct<start: int, back: int, priority: int, label: string, confidence: double>"
    state = F.struct(
        F.array_repeat(F.lit(-1), n).alias("reach"), F.array().cast(f"array<{element}>").alias("kept")
    )

    def step(s: Column, m: Column) -> Column:
        better = F.array_max(F.slice(s["reach"], F.lit(1), m["priority"] + 1))
        reach = F.transform(s["reach"], lambda r, i: F.when(i == m["priority"], F.greatest(r, -m["back"])).otherwise(r))
        kept = F.when(better >= -m["back"], s["kept"]).otherwise(F.concat(s["kept"], F.array(m)))
        return F.struct(reach.alias("reach"), kept.alias("kept"))

    return F.aggregate(ordered, state, step, lambda s: s["kept"])


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, labels and the best confidence."""
    text = F.col("_text")
    nothing = F.struct(
        F.lit(0).cast("bigint").alias("n_base"), F.lit(None).cast("bigint").alias("first_word"),
        F.lit(None).cast("bigint").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"),
        F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("n_matches"),
    )

    def result(words: Column) -> Column:
        def told(places: Column) -> Column:
            base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
            joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

            def combined(found: Column) -> Column:
                labels = F.array_sort(F.array_distinct(F.concat(base, F.transform(found, lambda m: m["label"]))))
                best = F.array_max(F.transform(found, lambda m: m["confidence"]))
                floor = F.when(F.size(places) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
                return F.struct(
                    F.size(places).cast("bigint").alias("n_base"),
                    F.get(places, F.lit(0))["at"].alias("first_word"),
                    F.get(places, F.size(places) - 1)["at"].alias("last_word"),
                    F.array_join(base, ",").alias("base_labels"),
                    F.array_join(labels, ",").alias("labels"),
                    F.greatest(F.coalesce(best, F.lit(0.0)), floor).alias("score"),
                    F.size(found).cast("bigint").alias("n_matches"),
                )

            return let(let(_matches(joined), _unsuppressed), combined)

        return let(_places(words), told)

    found = F.when(text.rlike(gate()), let(license_words(text), result)).otherwise(nothing)
    rows = docs.select("doc_id", text_of("text").alias("_text"))
    counted = rows.select(
        "doc_id", F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"), F.explode(F.array(found)).alias("_f")
    )
    return counted.select("doc_id", "n_words", "_f.*")


def check_rules() -> int:
    """Number of rules; each is a valid expression."""
    for *_, pattern in rules():
        re.compile(pattern)
    return len(rules())
