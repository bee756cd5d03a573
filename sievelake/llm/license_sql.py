"""The licence scan in DuckDB's SQL: word by word, with rules of its own."""

from __future__ import annotations

from sievelake.llm.license_texts import known_texts

#: What a word becomes, each case written out; words come in lower case.
WORD_CASES = r"""CASE
  WHEN regexp_full_match(w, '(sub|un)?licenc(e|es|ed|ing|or|ee|ees)') THEN replace(w, 'licenc', 'licens')
  WHEN w IN ('offence', 'offences', 'defence', 'defences', 'pretence', 'pretences') THEN replace(w, 'ence', 'ense')
  WHEN regexp_full_match(w, '(author|capital|categor|custom|emphas|final|formal|initial|maxim|minim|modern|normal|optim|organ|real|recogn|standard|summar|util)is(e|es|ed|er|ers|ing|ation|ations)')
    THEN regexp_replace(w, 'is(e|es|ed|er|ers|ing|ation|ations)$', 'iz\1')
  WHEN w IN ('analyse', 'analyses', 'analysed', 'analysing', 'paralyse', 'paralyses', 'paralysed', 'paralysing') THEN replace(w, 'lys', 'lyz')
  WHEN w IN ('centre', 'calibre', 'litre', 'fibre') THEN left(w, length(w) - 2) || 'er'
  WHEN w IN ('centres', 'calibres', 'litres', 'fibres') THEN left(w, length(w) - 3) || 'ers'
  WHEN w IN ('centred', 'calibred', 'litred', 'fibred') THEN left(w, length(w) - 3) || 'erd'
  WHEN regexp_full_match(w, '(fav|lab|col|behavi|hon|harb|endeav)our(s|ed|ing|able)?') THEN replace(w, 'our', 'or')
  WHEN regexp_full_match(w, '(cance|labe|mode|signa|trave|tota)ll(ed|ing|er)') THEN replace(w, 'll', 'l')
  WHEN regexp_full_match(w, '(acknowledg|judg|abridg)ements?') THEN replace(w, 'gement', 'gment')
  WHEN regexp_full_match(w, '(catalog|analog|dialog|prolog)ue[sd]?') THEN replace(w, 'ogue', 'og')
  WHEN w IN ('practise', 'practises', 'practised', 'practising') THEN replace(w, 'practis', 'practic')
  WHEN w IN ('artefact', 'artefacts') THEN replace(w, 'arte', 'arti')
  WHEN w IN ('programme', 'programmes') THEN replace(w, 'mme', 'm')
  WHEN w IN ('fulfil', 'fulfils', 'fulfilment') THEN replace(w, 'fulfil', 'fulfill')
  WHEN w IN ('wilful', 'wilfully') THEN replace(w, 'wil', 'will')
  WHEN w = 'whilst' THEN 'while'
  WHEN w = 'https' THEN 'http'
  ELSE w END"""


def _digest(text: str) -> str:
    lines = rf"regexp_replace(replace(replace(lower({text}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^[^\p{{L}}\p{{N}}\n]*(copyright( \(c\)| ©)?( |:|$)[^\n]*|(\(c\)|©)[^\n]*|all rights reserved[^\p{{L}}\p{{N}}\n]*)$', ' ', 'g')"
    words = rf"list_filter(regexp_split_to_array(replace({lines}, '&', ' and '), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    line = f"' ' || array_to_string(list_transform({words}, lambda w: {WORD_CASES}), '  ') || ' '"
    for run, kept in (
        (" sub  license ", " sublicense "), (" sub  licenses ", " sublicenses "), (" sub  licensed ", " sublicensed "), (" sub  licensing ", " sublicensing "),
        (" sub  licensor ", " sublicensor "), (" sub  licensee ", " sublicensee "), (" sub  licensees ", " sublicensees "), (" non  commercial ", " noncommercial "), (" non  infringement ", " noninfringement "), (" per  cent ", " percent "),
        (" copyright  owner ", " copyright  holder "), (" copyright  owners ", " copyright  holders "), (" merchant  ability ", " merchantability "),
    ):
        line = f"replace({line}, '{run}', '{kept}')"
    return f"sha256(replace(trim({line}), '  ', ' '))"


def scan_sql(docs: str = "documents") -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known_texts())
    return f"""
WITH known AS (SELECT {_digest('t')} AS license_digest, min(i) AS license_id FROM (VALUES {known}) AS k(i, t) GROUP BY 1),
scanned AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_digest('text')} END AS text_digest FROM {docs})
SELECT doc_id, text_digest, license_id FROM scanned LEFT JOIN known ON text_digest = license_digest
"""
