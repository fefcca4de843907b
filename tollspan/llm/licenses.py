"""License scans: ordered signature rules over a text's words, gated by keywords, with overlapping finds resolved.

A rule is a regular expression over the words, parted by single blanks. Texts without a trace of licensing pass
by after a search for a few dozen traces; of the others, only rules whose keyword is in the text are tried. A find inside one of
higher or equal priority is dropped, except those of the fixed base phrases. Everything is SQL functions on one
row at a time: no shuffle, however often a license or a document repeats.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm.common import LOWER, UPPER, free_name, table

#: A word, for texts in which A-Z may still be in upper case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that count wherever their words stand in a row, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_V = r"(?: version| v)?"
#: label, name as a pattern, keywords of which every form of the name holds one, SPDX words, words of the license's address,
#: and whether the name alone is telling enough.
LICENSES = (
    ("mit", "(?:mit|expat)", " mit | expat ", "mit", "mit", False),
    ("mit-0", "mit (?:no attribution|0)", " mit ", "mit 0", "mit 0", False),
    ("apache-2", f"apache(?: software)?(?: licen[cs]e)?{_V} 2(?: 0)?", "apache", "apache 2 0", "(?:apache )?license 2 0", True),
    ("apache-1.1", f"apache(?: software)?(?: licen[cs]e)?{_V} 1 1", "apache", "apache 1 1", "license 1 1", True),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd", "bsd 2 clause", "bsd 2 clause", True),
    ("bsd-3-clause", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd", "bsd 3 clause", "bsd 3 clause", True),
    ("bsd-4-clause", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd", "bsd 4 clause", "bsd 4 clause", True),
    ("bsd", "bsd(?: style)?", "bsd", "bsd", "bsd license", False),
    ("0bsd", "(?:zero clause bsd|0bsd|bsd zero clause)", "bsd", "0bsd", "0bsd", True),
    ("gpl-1", f"(?:gnu )?(?:gpl|general public licen[cs]e){_V} ?1(?: 0)?", "gpl|general public", "gpl 1 0(?: only| or later)?", "gpl 1 0", True),
    ("gpl-2", f"(?:gnu )?(?:gpl|general public licen[cs]e){_V} ?2(?: 0)?", "gpl|general public", "gpl 2 0(?: only| or later)?", "gpl 2 0", True),
    ("gpl-3", f"(?:gnu )?(?:gpl|general public licen[cs]e){_V} ?3(?: 0)?", "gpl|general public", "gpl 3 0(?: only| or later)?", "gpl 3 0", True),
    ("gpl", "(?:gnu )?(?:gpl|gnu general public)", "gpl|general public", "gpl", "gpl", False),
    ("lgpl-2", f"(?:gnu )?(?:lgpl|library general public licen[cs]e){_V} ?2(?: 0)?", "lgpl|library general", "lgpl 2 0(?: only| or later)?", "lgpl 2 0", True),
    ("lgpl-2.1", f"(?:gnu )?(?:lgpl|lesser general public licen[cs]e){_V} ?2 1", "lgpl|lesser general", "lgpl 2 1(?: only| or later)?", "lgpl 2 1", True),
    ("lgpl-3", f"(?:gnu )?(?:lgpl|lesser general public licen[cs]e){_V} ?3(?: 0)?", "lgpl|lesser general", "lgpl 3 0(?: only| or later)?", "lgpl 3 0", True),
    ("lgpl", "(?:gnu )?(?:lgpl|lesser general public|library general public)", "lgpl|lesser general|library general", "lgpl", "lgpl", False),
    ("agpl-3", f"(?:gnu )?(?:agpl|affero general public licen[cs]e){_V} ?3(?: 0)?", "agpl|affero", "agpl 3 0(?: only| or later)?", "agpl 3 0", True),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)", "agpl|affero", "agpl", "agpl", False),
    ("gfdl", f"(?:gnu )?(?:gfdl|free documentation)(?:{_V} 1 [123])?", "fdl|free documentation", "gfdl 1 [123](?: only| or later)?", "fdl(?: 1 [123])?", False),
    ("mpl-1.1", f"(?:mpl|mozilla public licen[cs]e){_V} 1 1", "mpl|mozilla", "mpl 1 1", "mpl 1 1", True),
    ("mpl-2", f"(?:mpl|mozilla public licen[cs]e){_V} 2(?: 0)?", "mpl|mozilla", "mpl 2 0", "mpl 2 0", True),
    ("mpl", "(?:mpl|mozilla public)", "mpl|mozilla", "mpl", "mpl", False),
    ("epl-1", f"(?:epl|eclipse public licen[cs]e){_V} 1(?: 0)?", "epl|eclipse", "epl 1 0", "epl 1 0", True),
    ("epl-2", f"(?:epl|eclipse public licen[cs]e){_V} 2(?: 0)?", "epl|eclipse", "epl 2 0", "epl 2 0", True),
    ("cddl-1", f"(?:cddl|common development and distribution licen[cs]e)(?:{_V} 1(?: [01])?)?", "cddl|common development", "cddl 1 [01]", "cddl 1 0", True),
    ("cpl-1", f"common public(?: licen[cs]e)?{_V} 1(?: 0)?", "common public| cpl ", "cpl 1 0", "cpl 1 0", True),
    ("isc", "isc", " isc ", "isc", "isc", False),
    ("zlib", "(?:zlib|zlib libpng)", "zlib", "zlib", "zlib", False),
    ("bsl-1", f"boost(?: software)?(?: licen[cs]e)?(?:{_V} 1(?: 0)?)?", "boost| bsl ", "bsl 1 0", "bsl 1 0", False),
    ("artistic-1", f"artistic(?: licen[cs]e)?{_V} 1(?: 0)?", "artistic", "artistic 1 0", "artistic 1 0", True),
    ("artistic-2", f"artistic(?: licen[cs]e)?{_V} 2(?: 0)?", "artistic", "artistic 2 0", "artistic 2 0", True),
    ("unlicense", "unlicense", "unlicense", "unlicense", "unlicense", True),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl|fuck", "wtfpl", "wtfpl", True),
    ("python-2", f"(?:python(?: software foundation)?|psf)(?: licen[cs]e)?(?:{_V} 2(?: 0)?)?", "python| psf ", "(?:python|psf) 2 0", "python 2 0", False),
    ("postgresql", "postgresql", "postgresql", "postgresql", "postgresql", False),
    ("openssl", "openssl", "openssl", "openssl", "openssl", False),
    ("ofl-1.1", f"(?:sil )?open font(?: licen[cs]e)?(?:{_V} 1 1)?", "open font| ofl ", "ofl 1 1", "ofl 1 1", True),
    ("eupl-1.2", f"(?:eupl|european union public licen[cs]e)(?:{_V} 1 2)?", "eupl|european union", "eupl 1 2", "eupl 1 2", True),
    ("upl-1", f"universal permissive(?: licen[cs]e)?(?:{_V} 1(?: 0)?)?", "universal permissive| upl ", "upl 1 0", "upl", True),
    ("ms-pl", "microsoft public", "microsoft public| ms pl ", "ms pl", "ms pl", False),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal| ms rl ", "ms rl", "ms rl", False),
    ("odbl-1", f"(?:odbl|open database licen[cs]e)(?:{_V} 1(?: 0)?)?", "odbl|open database", "odbl 1 0", "odbl 1 0", True),
    ("odc-by", f"(?:odc by|open data commons attribution)(?:{_V} 1(?: 0)?)?", " odc |open data commons|opendatacommons", "odc by 1 0", "by 1 0", True),
    ("pddl", f"(?:pddl|public domain dedication and licen[cs]e)(?:{_V} 1(?: 0)?)?", "pddl|public domain", "pddl 1 0", "pddl 1 0", True),
    ("cc0", f"(?:cc0|cc zero|creative commons zero)(?:{_V} 1(?: 0)?)?", "cc0|cc zero|commons zero|publicdomain zero", "cc0 1 0", "zero 1 0", True),
    ("cc-by", f"(?:cc by|creative commons(?: by| attribution))(?! (?:nc|nd|sa|non|no|share))(?:{_V} [1-4] [05])?", " cc by |creative", "cc by [1-4] [05]", "by [1-4] [05]", True),
    ("cc-by-sa", f"(?:cc by sa|creative commons(?: by sa| attribution share ?alike))(?:{_V} [1-4] [05])?", " cc by |creative", "cc by sa [1-4] [05]", "by sa [1-4] [05]", True),
    ("cc-by-nd", f"(?:cc by nd|creative commons(?: by nd| attribution no ?deriv(?:ative)?s?))(?:{_V} [1-4] [05])?", " cc by |creative", "cc by nd [1-4] [05]", "by nd [1-4] [05]", True),
    ("cc-by-nc", f"(?:cc by nc|creative commons(?: by nc| attribution non ?commercial))(?! (?:nd|sa|no|share))(?:{_V} [1-4] [05])?", " cc by |creative", "cc by nc [1-4] [05]", "by nc [1-4] [05]", True),
    ("cc-by-nc-sa", f"(?:cc by nc sa|creative commons(?: by nc sa| attribution non ?commercial share ?alike))(?:{_V} [1-4] [05])?", " cc by |creative", "cc by nc sa [1-4] [05]", "by nc sa [1-4] [05]", True),
    ("cc-by-nc-nd", f"(?:cc by nc nd|creative commons(?: by nc nd| attribution non ?commercial no ?deriv(?:ative)?s?))(?:{_V} [1-4] [05])?", " cc by |creative", "cc by nc nd [1-4] [05]", "by nc nd [1-4] [05]", True),
    ("public-domain", "public domain", "public domain|publicdomain", "(?:licenseref )?public domain", "public ?domain", False),
    ("proprietary", "(?:proprietary|commercial|all rights reserved)", "proprietary|commercial|rights reserved", "licenseref proprietary", "proprietary", False),
)

_LIC = r"licen[cs]e"
#: Forms in which a name shows that a text is licensed so: pattern, keyword, priority, confidence.
FORMS = (
    ("spdx licen[cs]e identifier {spdx}", "spdx", 7, 1.0),
    (
        r"(?:licen[cs]ed|released|distributed|redistributed|published|available|provided|offered|shared)"
        r"(?: [^ ]+){{0,3}}? (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?{name}(?: (?:public )?" + _LIC + ")?",
        " ", 6, 0.95,
    ),
    (r"under (?:the )?(?:terms of )?(?:the )?{name} " + _LIC, "licen", 5, 0.9),
    (r"(?:opensource|spdx|gnu|apache|mozilla|eclipse|creativecommons) org (?:licenses?|licences?|legal|publicdomain|copyleft)? ?{url}", " org ", 4, 0.9),
    (r"(?:the )?{name} " + _LIC, "licen", 3, 0.7),
)
TOP = 9

#: Traces, one of which a text must hold for any rule to match: the telling part of every name and form.
TRACES = (
    "licenc", "licens", "spdx", "opensource", "gnu", "mozilla", "eclipse", "creative", "commons", "released", "distributed",
    "published", "available", "provided", "offered", "shared", "gpl", "mpl", "epl", "bsd", "cddl", "common", "artistic", "wtfpl",
    "fuck", "open font", "eupl", "permissive", "odbl", "odc", "open data", "pddl", "cc0", "apache",
)


def rules() -> list[dict]:
    """All rules in their order: base phrases, then by priority; a rule's number is its place."""
    found = [
        {"label": label, "form": f" {phrase} ", "keywords": [" "], "regex": phrase, "priority": TOP, "score": 1.0, "base": True}
        for phrase, label in BASE
    ]
    for form, trace, priority, score in FORMS:
        found += [
            {"label": label, "form": trace, "keywords": words.split("|"), "regex": form.format(name=name, spdx=spdx, url=url),
             "priority": priority, "score": score, "base": False}
            for label, name, words, spdx, url, _ in LICENSES
        ]
    found += [
        {"label": label, "form": " ", "keywords": words.split("|"), "regex": name, "priority": 2, "score": 0.5, "base": False}
        for label, name, words, _, _, telling in LICENSES
        if telling
    ]
    return [r | {"regex": f"(?<= )(?:{r['regex']})(?= )"} for r in found]


def traced(low: str) -> Column:
    """Whether a column of lowered text holds a trace; those of two words may be parted by more than a blank."""
    found = F.contains(low, F.lit("cc")) & F.col(low).rlike("(?<![a-z0-9])cc(?![a-z0-9])")
    for trace in TRACES:
        for n, word in enumerate(trace.split()):
            one = F.contains(low, F.lit(word)) if not n else one & F.contains(low, F.lit(word))
        found |= one
    return found


def finds(low: str) -> Column:
    """All finds of all rules in a column of lowered text, as structs sorted by first word, longest first.

    Words are numbered from 0; `last` is the number of the find's last word.
    """
    listed = F.from_json(
        F.lit(json.dumps(rules())),
        "array<struct<label: string, form: string, keywords: array<string>, regex: string, priority: int, score: double, base: boolean>>",
    )
    norm = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), " "), F.lit(" "))

    def blanks(s: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(" ")))

    def spans(rule: Column, norm: Column) -> Column:
        hits = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
        between = F.split(norm, rule["regex"], -1)
        step = F.arrays_zip(F.transform(between, blanks).alias("gap"), F.transform(hits, blanks).alias("own"))
        start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first: int, last: int>>").alias("out"))
        walked = F.aggregate(
            F.filter(step, lambda s: s["own"].isNotNull()),
            start,
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["own"]).alias("at"),
                F.array_append(
                    acc["out"],
                    F.struct((acc["at"] + s["gap"]).alias("first"), (acc["at"] + s["gap"] + s["own"]).alias("last")),
                ).alias("out"),
            ),
        )
        return F.transform(
            walked["out"],
            lambda s: F.struct(
                s["first"].alias("first"), (-s["last"]).alias("order"), (-rule["priority"]).alias("rank"), rule["label"].alias("label"),
                s["last"].alias("last"), rule["priority"].alias("priority"), rule["score"].alias("score"), rule["base"].alias("base"),
            ),
        )

    def scan(norm: Column) -> Column:
        tried = F.filter(
            listed, lambda r: F.contains(norm, r["form"]) & F.exists(r["keywords"], lambda k: F.contains(norm, k))
        )
        return F.array_sort(F.flatten(F.transform(tried, lambda r: spans(r, norm))))

    return F.flatten(F.transform(F.array(norm), scan))


def kept(found: Column) -> Column:
    """Finds that no find of higher or equal priority contains; base finds stay. One pass in order of first word.

    The state is the last word reached by finds of at least each priority: whatever contains a find starts no
    later, so it has been met before.
    """
    start = F.struct(
        F.array_repeat(F.lit(-1), TOP + 1).alias("reach"), F.filter(found, lambda f: F.lit(False)).alias("out")
    )

    def step(acc: Column, f: Column) -> Column:
        inside = F.get(acc["reach"], f["priority"]) >= f["last"]
        return F.struct(
            F.transform(acc["reach"], lambda r, p: F.when((p <= f["priority"]) & (r < f["last"]), f["last"]).otherwise(r)).alias("reach"),
            F.when(f["base"] | ~inside, F.array_append(acc["out"], f)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(found, start, step)["out"]


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `n_words` and `licenses`, an array of structs (first, last, label, priority, score, base).

    Null and empty texts have 0 words and no finds. Rows, null and repeated ids pass through as they are.
    Columns of those two names are replaced. An empty table gives no rows.
    """
    taken = {"n_words", "licenses"}
    plain = docs.select(*[c for c in docs.columns if c.lower() not in taken])
    low, hit, found, left = (free_name(plain.columns, c) for c in ("_low", "_hit", "_found", "_left"))
    # a column of its own for each step, as a longer expression would work out its parts again and again
    steps = plain.withColumn(low, F.translate(text_col, UPPER, LOWER)).withColumn(hit, traced(low))
    steps = steps.withColumn(found, F.when(F.col(hit), finds(low))).withColumn(left, kept(F.col(found)))
    slim = F.transform(left, lambda f: F.struct(*[f[c].alias(c) for c in ("first", "last", "label", "priority", "score", "base")]))
    empty = F.array().cast("array<struct<first: int, last: int, label: string, priority: int, score: double, base: boolean>>")
    words = F.coalesce(F.regexp_count(low, F.lit(WORD)), F.lit(0)).cast("bigint")
    return steps.select(*plain.columns, words.alias("n_words"), F.when(F.col(left).isNull(), empty).otherwise(slim).alias("licenses"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licenses", lambda f: f["base"])

    def joined(finds: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))), ",")

    return found.select("doc_id", "n_words", "licenses").select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["first"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["first"])).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )
