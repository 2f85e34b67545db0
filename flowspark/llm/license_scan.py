"""Licence scan with a positional index of rare words, as DataFrame functions alone.

Templates are word sequences with a mandatory key phrase. The index maps a word to the places it has
in templates; the document frequency of the templates' words over all documents gives their IDF, and
the two words of highest IDF inside a key phrase are what a file is searched for. Occurrences of the
rarer one, moved back by its place, are the candidate starts; the second one must stand at its own
place from the same start, and the key phrase is then verified word by word. The share of a
template's words in place is the score of a start.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows get equal
results; a template counts at most once among the labels and at every place in the counts. A place
may be shared by several phrases. Other columns are ignored; an empty table gives no rows.

scan looks for the ten templates of its statement and asks for MIN_SHARE of their words, so it gives
no label to other usual wordings. notices looks for the usual notices, short titles and identifiers
as well; there the verified key phrase alone gives the label and the share is only the score.
"""

from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count as base, with their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Label, words of the template, key phrase in it. Wording of common licence notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "permission to use copy modify and or distribute"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)
#: Share of a template's words that must stand in place for its label in scan.
MIN_SHARE = 0.8
_FSF = "as published by the free software foundation either version"
_ISC = "distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"
#: Label, words of the notice, key phrase in it, words that may not follow the key phrase (another licence then).
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0", ()),
    ("apache-2.0", "apache license 2 0", "apache license 2 0", ()),
    ("apache-2.0", "apache 2 0", "apache 2 0", ()),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms", ()),
    ("bsd", "bsd license", "bsd license", ()),
    ("bsd", "bsd 2 clause", "bsd 2 clause", ()),
    ("bsd", "bsd 3 clause", "bsd 3 clause", ()),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", ("sa", "nd")),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial",
     ("sharealike", "noderivatives", "noderivs")),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", ()),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives",
     "creative commons attribution noncommercial noderivatives", ()),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", ()),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike",
     "creative commons attribution noncommercial sharealike", ()),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", ()),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike", ()),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3", ()),
    ("gpl-3.0", f"under the terms of the gnu general public license {_FSF} 3 of the license or at your option any later version",
     f"gnu general public license {_FSF} 3", ()),
    ("gpl-3.0", "version 3 of the gnu general public license", "version 3 of the gnu general public license", ()),
    ("gpl-3.0", "gnu gpl version 3", "gpl version 3", ()),
    ("gpl-3.0", "gnu gpl v3", "gpl v3", ()),
    ("gpl-3.0", "gplv3", "gplv3", ()),
    ("gpl-3.0", "gpl 3 0", "gpl 3 0", ()),
    ("isc", f"permission to use copy modify and or {_ISC}", f"permission to use copy modify and or {_ISC}", ()),
    ("isc", f"permission to use copy modify and {_ISC}", f"permission to use copy modify and {_ISC}", ()),
    ("isc", "isc license", "isc license", ()),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license", ()),
    ("lgpl", "gnu library general public license", "gnu library general public license", ()),
    ("lgpl", "gnu lgpl", "lgpl", ()),
    ("lgpl", "lgplv3", "lgplv3", ()),
    ("mit", "released under the mit license", "mit license", ()),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights "
     "to use copy modify merge publish distribute sublicense and or sell copies of the software",
     "to any person obtaining a copy of this software and associated documentation files the software to deal in the software", ()),
    ("mit", "spdx license identifier mit", "license identifier mit", ("0",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0", ()),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0", ()),
    ("mpl-2.0", "mozilla public license 2 0", "mozilla public license 2 0", ()),
    ("mpl-2.0", "mpl 2 0", "mpl 2 0", ()),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software", ()),
    ("unlicense", "the unlicense", "the unlicense", ()),
)


def _let(value, body):
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text):
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _all_templates(wanted=TEMPLATES):
    """(label, words, start and end of the key phrase, base or not, words that may not follow it)."""
    for phrase, label in BASE:
        yield label, phrase.split(), 0, len(phrase.split()), True, ()
    for label, text, key, *apart in wanted:
        words, key = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        yield label, words, at, at + len(key), False, (apart[0] if apart else ())


def word_frequencies(docs, wanted=TEMPLATES):
    """In how many documents each word of the templates stands, over all documents."""
    vocabulary = sorted({w for _, words, *_ in _all_templates(wanted) for w in words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    rows = docs.select(F.explode(F.array_intersect(_words(F.col("text")), known)).alias("word"))
    counts = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _anchors(words, first, last, frequency):
    """Places of the two rarest words of a key phrase, the rarest first."""
    return sorted(range(first, last), key=lambda i: (frequency[words[i]], i))[:2]


def _starts(words, hits, template, first, last, apart, anchors):
    """Starts of the template whose key phrase stands in the file, from the rare words' places."""
    starts = F.transform(F.filter(hits, lambda h: h["w"] == F.lit(template[anchors[0]])), lambda h: h["i"] - anchors[0])
    if anchors[1:]:
        second = anchors[1]
        starts = F.filter(starts, lambda s: F.get(words, s + second) == F.lit(template[second]))
    key = F.array(*[F.lit(w) for w in template[first:last]])
    # a template may begin before the file does; its key phrase may not
    starts = F.filter(starts, lambda s: (s + first >= 0) & (F.slice(words, F.greatest(s + first, F.lit(0)) + 1, last - first) == key))
    return F.filter(starts, lambda s: ~F.coalesce(F.get(words, s + last).isin(*apart), F.lit(False))) if apart else starts


def _share(words, start, template):
    same = sum((F.coalesce(F.get(words, start + k) == F.lit(w), F.lit(False)).cast("int") for k, w in enumerate(template)), F.lit(0))
    return same / F.lit(float(len(template)))


def _share_of_long(words, start, template):
    """_share over an array of constants, as long notices would make too many expressions."""
    same = F.filter(F.array(*[F.lit(w) for w in template]), lambda w, k: F.get(words, start + k) == w)
    return F.size(same) / F.lit(float(len(template)))


def _shares(words, starts, template, share):
    return F.transform(starts, lambda s: share(words, s, template))


def scan(docs):
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return _scan(docs, TEMPLATES, MIN_SHARE, _share)


def notices(docs):
    """The columns of scan, with the labels of all usual notices whose key phrase stands in the text."""
    return _scan(docs, NOTICES, 0.0, _share_of_long)


def _scan(docs, wanted, min_share, share):
    plain = columns_of(docs, "doc_id", "text")
    frequency = word_frequencies(plain, wanted)
    templates = [(*t, _anchors(t[1], t[2], t[3], frequency)) for t in _all_templates(wanted)]
    rare = sorted({t[1][t[-1][0]] for t in templates})

    def judge(words, hits):
        places = [(label, t, base, _starts(words, hits, t, a, b, apart, anchors)) for label, t, a, b, base, apart, anchors in templates]
        base = F.flatten(F.array(*[p for _, _, is_base, p in places if is_base]))
        none = F.array().cast("array<double>")
        shares = [(label, none if is_base else _shares(words, p, t, share), is_base, p) for label, t, is_base, p in places]
        found = [F.when(F.size(p) > 0 if is_base else F.exists(s, lambda x: x >= min_share), F.lit(label))
                 for label, s, is_base, p in shares]
        own = [f for f, (_, _, is_base, _) in zip(found, shares) if is_base]
        best = [F.when(F.size(p) > 0, 1.0).otherwise(0.0) if is_base else F.coalesce(F.array_max(s), F.lit(0.0))
                for _, s, is_base, p in shares]
        joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
            F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
            joined(own).alias("base_labels"), joined(found).alias("labels"), F.greatest(*best).alias("score"))

    def places(words):
        hits = F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(i.alias("i"), w.alias("w"))))
        return _let(F.filter(hits, lambda h: h.isNotNull()), lambda h: judge(words, h))

    out = plain.select("doc_id", _let(_words(F.col("text")), places).alias("found"))
    return out.select("doc_id", "found.*")


def _sql():
    rows = ", ".join(
        f"('{label}', {list(words)!r}, {first}, {last}, {base})" for label, words, first, last, base, _ in _all_templates())
    return rf"""
WITH t(label, tw, a, b, base) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT r, w, i FROM (SELECT r, w, unnest(generate_series(0, len(w) - 1)) AS i FROM d WHERE len(w) > 0)
      WHERE w[i + 1] IN (SELECT tw[a + 1] FROM t)),
f AS (SELECT p.r, t.label, t.base, p.i - t.a AS start,
             list_sum(list_transform(range(len(t.tw)), lambda k:
               CASE WHEN p.i - t.a + k >= 0 AND p.w[p.i - t.a + k + 1] = t.tw[k + 1] THEN 1 ELSE 0 END)) / len(t.tw) AS share
      FROM p JOIN t ON p.w[p.i + 1] = t.tw[t.a + 1] AND p.w[p.i + 1:p.i + t.b - t.a] = t.tw[t.a + 1:t.b]),
n AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
             max(start) FILTER (WHERE base) AS last_word, max(share) AS score,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR share >= {MIN_SHARE}) AS labels
      FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN n USING (r)
"""


SQL = _sql()


def _notices_sql():
    rows = ", ".join(f"('{label}', {list(words)!r}, {first}, {last}, {base}, {list(apart) or ['']!r})"
                     for label, words, first, last, base, apart in _all_templates(NOTICES))
    return rf"""
WITH t(label, tw, a, b, base, apart) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT r, w, i FROM (SELECT r, w, unnest(generate_series(0, len(w) - 1)) AS i FROM d WHERE len(w) > 0)
      WHERE w[i + 1] IN (SELECT tw[a + 1] FROM t)),
f AS (SELECT p.r, t.label, t.base, p.i - t.a AS start,
             list_sum(list_transform(range(len(t.tw)), lambda k:
               CASE WHEN p.i - t.a + k >= 0 AND p.w[p.i - t.a + k + 1] = t.tw[k + 1] THEN 1 ELSE 0 END)) / len(t.tw) AS share
      FROM p JOIN t ON p.w[p.i + 1] = t.tw[t.a + 1] AND p.w[p.i + 1:p.i + t.b - t.a] = t.tw[t.a + 1:t.b]
      WHERE NOT coalesce(list_contains(t.apart, p.w[p.i + t.b - t.a + 1]), false)),
n AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
             max(start) FILTER (WHERE base) AS last_word, max(share) AS score,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN n USING (r)
"""


NOTICES_SQL = _notices_sql()
