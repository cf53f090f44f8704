"""Run parameters as frozen dataclasses.

Every default below is a fixed value that must equal the original pipeline's for
identical results; they are kept together, as plain text, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original pipeline exactly)
# ---------------------------------------------------------------------------

# Content-filter regular expressions (Python flavour; evaluated case-insensitively).
POSITIVE_PATTERN = r"whole[\s\-]?genome|WGS|resequenc"
NEGATIVE_PATTERN = (
    r"0K-exome|targeted|amplicon|panel|GBS|genotyping(\s+by\s+sequencing)?|GenomeStudio|"
    r"SNP([\s\-]?array)?|microarray|Infinium|Axiom|expression|transcriptome|RNA[\s\-]?seq|"
    r"mRNA|SSR(s)?|microsatellite|RAD[\s\-]?seq|ddRAD|SLAF|reduced\s+representation|capture|"
    r"hybrid[\s\-]?capture|chloroplast|mitochondri|mitochondrial\s+genome|plastid|plastome|"
    r"mitogenome"
)
EXCLUDED_PUBTYPE_PATTERN = r"Review|Editorial|Letter|Meta-Analysis|News|Comment"
COMPARATIVE_PATTERN = (
    r"variant|polymorphism|SNP|indel|SV|structural\s+variant|copy\s+number|CNV|haplotype|"
    r"diversity|population|comparative|resequenc|association|GWAS|selection|adaptation|"
    r"introgression|domestication|pangenome|pan[\s\-]?genome|phylogeny|evolution"
)
ASSEMBLY_PATTERN = r"(de[\s\-]?novo\s+)?assembly|genome\s+assembly"

# Ranking knobs.
MIN_CANDIDATE_ID = 21980108
AGE_BETA = 0.3
AGE_GAMMA = 0.7
COMPARATIVE_BOOST = 1.15
FIXED_THRESHOLDS = (2, 3, 5, 10)
RECOMMENDED_FLOOR = 2          # recommended threshold = max(2, max_score // 10)
RECOMMENDED_DIVISOR = 10
MEDIUM_TIER_FLOOR = 3          # medium tier: 3 <= score < recommended

# Report layout of the term-count table.
REPORT_TITLE = "Search Results"
REPORT_TOTAL_LABEL = "Total Markdown files searched: "
REPORT_NAME_HEADER = "Search Term"
REPORT_COUNT_HEADER = "Papers Found"
REPORT_NAME_WIDTH = 40
REPORT_COUNT_WIDTH = 12
REPORT_RULE_WIDTH = 59

# Conversion QA.
SNIFF_LINES = 5
SNIFF_MARKERS = ("pmc-articleset", "jats", "article xmlns")
SMALL_RATIO_PERCENT = 10
FEW_LINES = 50
SOME_LINES = 100
BIBLIOGRAPHY_HEADINGS = ("References", "Reference", "Bibliography", "Literature Cited")

# Landing.
RESTRICTED_NEEDLE = "publisher of this article does not allow"
PMC_PREFIX = "PMC"

# Search query of the corpus-search step (free-text form, publication-type field).
SEARCH_QUERY_TERMS = ("plant genome resequencing", "whole genome")
SEARCH_QUERY_EXCLUDED_PUBTYPE = "review"

# Shipped term dictionary, one "Name: alt1|alt2" line per group, in file order.
SHIPPED_TERM_LINES = (
    "Fst: Fst",
    "Go terms: GO enrichment|gene ontology",
    "GWAS: GWAS|genome wide association|genome-wide association",
    "SNP: single nucleotide polymorphism|SNP|single nucleotide variant",
    "Qst: Qst",
    "adaptive introgression: adaptive introgression",
    "ancestral recombination graph: ancestral recombination graph|ARG",
    "balancing selection: balanced selection|balancing selection",
    "chromosome inversion: chromosomal inversion|chromosome inversion",
    "common garden: common garden",
    "deleterious variants: deleterious variants|deleterious substitution",
    "diversifying selection: diversifying selection",
    "environmental association: genotype environment association|landscape genomics",
    "genetic load: genetic load|mutational load",
    "hard sweep: hard sweep",
    "Hill-Robertson: Hill-Robertson",
    "hybridization: hybridization",
    "introgression: introgression",
    "linked selection: linked selection",
    "linkage drag: linkage drag",
    "mutation rate: mutation rate|substitution rate",
    "nucleotide diversity: nucleotide diversity",
    "nucleotide polymorphism: nucleotide polymorphism",
    "omnigenic: omnigenic",
    "partial sweep: partial sweep| partial selective sweep",
    "plant adaptation: plant adaptation",
    "polygenic adaptation: polygenic adaptation|polygenic selection|polygenic trait",
    "pooled sequencing: pooled sequence|pooled sequencing",
    "positive selection: positive selection",
    "purifying selection: purifying selection|negative selection",
    "selection coefficient: selection coefficient|selective coefficient",
    "selective sweep: selective sweep",
    "sequence diversity: sequence diversity",
    "SNP annotation: SNP annotation|snpeff|SnpEff|Annovar|VeP|Variant Effect Predictor",
    "soft sweep: soft sweep",
    "tree sequence: tree sequence",
)

# Column headers of the two extraction-table layouts (25 and 23 columns).
EXTRACTION_V25_COLUMNS = (
    "Authors", "Title", "Journal", "Publication year", "DOI", "PMID", "PMCID",
    "Species examined", "Samples per species",
    "Mentions selective sweeps or selection events (Yes/No)",
    "Selective sweep detection methods", "Mentions selection coefficient (Yes/No)",
    "Selection coefficient value", "Mentions pooled sequencing", "Mentions soft sweeps",
    "Soft sweep detection tools (if applicable)",
    "Mentions balancing or stabilizing selection (Yes/No)",
    "Mentions purifying or negative selection (Yes/No)",
    "Mentions GO term enrichment (Yes/No)", "Mentioned GO terms (if applicable)",
    "Genes mentioned (all specific gene names)", "Genes in selective sweeps",
    "Mentions polygenic selection (Yes/No)", "Polygenic selection traits (if applicable)",
    "Notes",
)
EXTRACTION_V23_COLUMNS = (
    "Authors", "Title", "Journal", "Publication year", "DOI", "Species examined",
    "Samples per species", "Mentions selective sweeps or events (Yes/No)",
    "Methods selective sweeps (if Yes to 'Mentions selective sweeps' - methods used for detection)",
    "Mentions selection coefficient (Yes/No)",
    "Selection coefficient value (If Yes to 'Mentions selection coefficient')",
    "Mentions pooled sequencing", "Mentions soft sweeps",
    "Soft sweep detection tools (list of tools, (e.g., H12/H1, S/HIC, diploS/HIC, FILET, DeepSweep)",
    "Mentions balancing or stabilizing selection", "Mentions purifying or negative selection?",
    "Mentions GO term enrichment? (Yes/No)",
    "Mentions GO terms? (if Yes to 'Mentions GO term enrichment')",
    "Genes mentioned (all specific gene names)", "Genes in selective sweeps",
    "Mentions polygenic selection (Yes/No)",
    "Polygenic selection traits (if Yes to 'Mentions polygenic selection')", "Notes",
)

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RankConfig:
    """Parameters of seed expansion, content filtering and age-weighted ranking."""

    min_id: int = MIN_CANDIDATE_ID
    beta: float = AGE_BETA
    gamma: float = AGE_GAMMA
    boost: float = COMPARATIVE_BOOST
    positive: str = POSITIVE_PATTERN
    negative: str = NEGATIVE_PATTERN
    pubtype: str = EXCLUDED_PUBTYPE_PATTERN
    comparative: str = COMPARATIVE_PATTERN
    assembly: str = ASSEMBLY_PATTERN
    require_positive: bool = True
    assembly_only_exclude: bool = True
    thresholds: tuple = FIXED_THRESHOLDS
    exclusive_tiers: bool = False     # False = overlapping tiers as in the Python twin
    whole_word: bool = False          # True: content patterns match whole words only (T18)
    pubtype_strict: bool = False      # True: exact type membership instead of substring (D4)
    max_seeds: int | None = None      # first N seeds by ord; None/0 = all
    distinct_edges: bool = False      # True: a repeated (seed, candidate) edge counts once


@dataclass(frozen=True)
class TermConfig:
    """Parameters of dictionary term search."""

    case_insensitive: bool = True
    whole_word: bool = True
    regex: bool = False               # True: alternatives are regexes (shell flavour)
    last_wins: bool = False           # duplicate group names: error unless True
    max_regex_alternatives: int = 500  # above this the automaton runs (same rows)
    automaton_chars: int = 1 << 18    # characters of all alternatives; above this the token plan runs (same rows)
    normalize_ws: bool = False        # True: a space in a phrase also matches line breaks


@dataclass(frozen=True)
class LandConfig:
    """Parameters of crosswalk and landing."""

    needle: str = RESTRICTED_NEEDLE
    retry_restricted: bool = True     # False: restricted documents are not fetched again (T14)
    prefix: str = PMC_PREFIX


@dataclass(frozen=True)
class ConvertConfig:
    sniff_lines: int = SNIFF_LINES
    markers: tuple = field(default=SNIFF_MARKERS)
    small_ratio: int = SMALL_RATIO_PERCENT
    few_lines: int = FEW_LINES
    some_lines: int = SOME_LINES
    headings: tuple = field(default=BIBLIOGRAPHY_HEADINGS)
