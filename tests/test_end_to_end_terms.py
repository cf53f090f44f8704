"""Files on disk → corpus scan → dictionary scan → counts, checked against a
plain-Python evaluation of the same semantics (re.escape, \\b, IGNORECASE)."""

import os
import re

from citeflow.operators import terms as tm
from citeflow.sources import readers as rd
from citeflow.sources.sinks import report_lines

TEXTS = {
    "a.md": "Selective sweep detected. GWAS hits and SnpEff annotations.",
    "sub/b.md": "genome-wide association of ÉTUDE; polygenic\nselection",
    "sub/deep/c.md": "no terms here, only Fst_like words and snp-array",
    "d.md": "Hill-Robertson effect; partial selective sweep; ARG inference",
    "e.md": "Positive selection: positive SELECTION, Qst and fst.",
    "skip.MD": "GWAS in an upper-case extension is not part of the corpus",
}
DICT = """# comment line
GWAS: GWAS|genome wide association|genome-wide association
SNP annotation: SNP annotation|snpeff|Annovar
Fst: Fst
selective sweep: selective sweep
partial sweep: partial sweep| partial selective sweep
Hill-Robertson: Hill-Robertson
positive selection: positive selection
polygenic: polygenic selection
etude: étude
ARG: ARG
absent: zzz
broken line without colon
"""


def _python_counts(root, lines):
    groups = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#") or ":" not in line:
            continue
        name, pats = line.split(":", 1)
        alts = [p.strip() for p in pats.strip().split("|") if p.strip()]
        groups.append((name.strip(), alts))
    files = []
    for d, _, fs in os.walk(root):
        files += [os.path.join(d, f) for f in fs if f.endswith(".md")]
    out = {}
    for name, alts in groups:
        hit = set()
        for p in alts:
            rx = re.compile(r"\b" + re.escape(p) + r"\b", re.IGNORECASE)
            for f in files:
                with open(f, encoding="utf-8", errors="ignore") as fh:
                    if rx.search(fh.read()):
                        hit.add(f)
        out[name] = len(hit)
    return out, len(files)


def test_files_to_counts(spark, scratch):
    root = os.path.join(scratch, "corpus")
    for rel, text in TEXTS.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(scratch, "terms.txt"), "w") as f:
        f.write(DICT)
    corpus = rd.corpus(spark, root)
    groups = tm.term_groups(tm.parse_terms(rd.text_lines(spark, os.path.join(scratch, "terms.txt"))))
    got = {r["term"]: r["papers"] for r in tm.term_hits(corpus, groups, key="path").collect()}
    want, n_files = _python_counts(root, DICT.splitlines())
    assert got == want
    assert corpus.count() == n_files == 5
    lines = [r["line"] for r in report_lines(tm.term_hits(corpus, groups, key="path"), n_files)
             .orderBy("line_no").collect()]
    assert lines[3] == "Total Markdown files searched: 5"
    assert len(lines) == 9 + len(want)
