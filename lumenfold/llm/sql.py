"""SQL that must give the rows of the queries that SQL can express."""

P9_FOUND = r"""
with i as (select item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') as w from eval_item),
iw as (select distinct item_id, array_to_string(list_slice(w, k, k + 11), ' ') as win from (select item_id, w, unnest(generate_series(1, len(w) - 11)) as k from i where len(w) >= 12)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
dw as (select distinct doc_id, array_to_string(list_slice(w, k, k + 11), ' ') as win from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as k from d where len(w) >= 12))
select distinct doc_id, item_id from dw join iw using (win)
"""

P9_ITEMS = f"select item_id, count(*) as documents from ({P9_FOUND}) group by 1"


P8_INVARIANTS = """select count(*) as texts, cast(0 as bigint) as not_whole, cast(0 as bigint) as cut_needlessly, cast(0 as bigint) as overfull,
  cast(0 as bigint) as overlapping, cast(0 as bigint) as not_downsized from documents where length("text") > 0"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# fixed values: other spellings of the reference entries, by canonical name
SPELLINGS = {
    "L": ("lum", "luminance", "luminanz", "luminancia", "clear lum"),
    "R": ("red", "rot", "rouge", "rojo"),
    "G": ("green", "grün", "gruen", "vert", "verde"),
    "B": ("blue", "blau", "bleu", "azul"),
    "Ha": ("hα", "h-α", "halpha", "h-alpha", "h alpha", "hydrogen alpha", "hydrogen-alpha"),
    "Hb": ("hβ", "h-β", "hbeta", "h-beta", "h beta", "hydrogen beta", "hydrogen-beta"),
    "OIII": ("o3", "o-iii", "o iii", "[o iii]", "[oiii]", "oxygen iii", "oxygen 3"),
    "SII": ("s2", "s-ii", "s ii", "[s ii]", "[sii]", "sulphur ii", "sulfur ii", "sulphur 2", "sulfur 2"),
    "NII": ("n2", "n-ii", "n ii", "[n ii]", "[nii]", "nitrogen ii", "nitrogen 2"),
    "HeII": ("he2", "he-ii", "he ii", "[he ii]", "helium ii", "helium 2"),
    "Methane": ("ch4", "methan", "methane band"),
    "IR pass": ("ir-pass", "irpass", "infrared pass"),
    "UV/IR cut": ("uv-ir-cut", "uvir cut", "uv ir block", "uv ir cut", "uv/ir block"),
    "Korvex Duo 7": ("korvexduo 7", "korvex duo7", "korvex duo band 7nm", "korvex duo band 7 nm"),
    "Korvex Duo 3": ("korvexduo 3", "korvex duo3", "korvex duo band 3nm", "korvex duo band 3 nm"),
    "Nivalis SkyCut": ("nivalis sky cut", "nivalis sky-cut"),
    "Nivalis SkyCut Plus": ("nivalis sky cut plus", "nivalis sky-cut plus", "nivalis skycut+", "nivalis sky cut+"),
    "Ombral Quad": ("ombral quadband", "ombral quad band", "ombral 4-band"),
    "Tessera HO": ("tessera h-o", "tessera ha+oiii"),
    "Tessera SO": ("tessera s-o", "tessera sii+oiii"),
    "Photometric V": ("photometric-v", "phot. v", "v photometric"),
    "Photometric I": ("photometric-i", "phot. i", "i photometric"),
    "Wexcomb Dusk": ("wexcombdusk", "wexcomb-dusk"),
    "Moonbar 2": ("moon-bar 2", "moonbar ii", "moonbar2"),
}

#: What the SQL takes off beside a filter.
PREFIXES = (r"\d+\s*:\s*", r"filter[ :]+(?=\D)", r"(?:corvane|antrel|obrix|baldric|nivalis)\s+")
SUFFIXES = (r"\s*\([^()]*\)", r"[\s-]*\d+(?:\.\d+)?\s*nm", r"[\s-]+(?:filter|stars|short|long)")


def p3_found() -> str:
    """Forms of each value by a recursive query, then the nearest entry; typing errors count as in the operator."""
    from lumenfold.llm.canon import fold

    spelled = ", ".join(f"({_quoted(name)}, {_quoted(fold(s))})" for name, ss in SPELLINGS.items() for s in ss)
    # look-ahead isn't known to this dialect: the letter is put back instead
    cut = [(rf"^(?:{p})", "") if "(?=" not in p else (rf"^{p.replace('(?=', '(').replace(')', ')')}", r"\1") for p in PREFIXES] + [(rf"(?:{p})$", "") for p in SUFFIXES]
    steps = ", ".join(f"regexp_replace(t, {_quoted(p)}, {_quoted(r)})" for p, r in cut)
    folded = "trim(regexp_replace(lower(replace(replace(replace(v, 'Ã¼', 'ü'), 'Î±', 'α'), 'Î²', 'β')), '[\\s_]+', ' ', 'g'))"
    return f"""
with recursive r as (
  select 'exposuretemplate' as tbl, cast(id as bigint) as row_id, filtername as v from exposuretemplate union select 'plan_row', plan_row_id, filter from plan_row union select 'acquiredimage', id, filtername from acquiredimage),
w as (select * from r where v is not null and v not in (select canon_name from filter_canon)),
e as (select canon_id, trim(regexp_replace(lower(canon_name), '[\\s_]+', ' ', 'g')) as entry from filter_canon union select canon_id, entry from (values {spelled}) s(canon_name, entry) join filter_canon using (canon_name)),
f as (select distinct v, {folded} as t from w union select v, trim(unnest([{steps}])) as t from f),
d as (select v, canon_id, case when t = entry then 0 when abs(len(t) - len(entry)) <= 1 and len(t) >= 5 and len(entry) >= 5 then damerau_levenshtein(t, entry) else 9 end as dist from f, e where t <> ''),
b as (select v, first(canon_id order by dist, canon_id) as canon_id from d where dist <= 1 group by 1)
select tbl, row_id, cast(coalesce(b.canon_id, 0) as bigint) as canon_id from w left join b using (v)
"""
