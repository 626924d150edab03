"""Word lists and lookup tables of run annotation."""

from __future__ import annotations

# Fixed values from here on: names, patterns and the labels they stand for.

ASSAYS = {
    "RNA-Seq": "rna_seq", "FL-cDNA": "rna_seq", "ssRNA-seq": "rna_seq", "ATAC-seq": "atac_seq", "ChIP-Seq": "chip_seq",
    "miRNA-Seq": "small_rna", "ncRNA-Seq": "small_rna", "RIP-Seq": "rip_seq", "Bisulfite-Seq": "other_genomics",
    "WGS": "other_genomics", "WXS": "other_genomics", "AMPLICON": "other_genomics", "OTHER": "other_genomics",
}
SOURCES = {"TRANSCRIPTOMIC SINGLE CELL": "sc", "TRANSCRIPTOMIC": "bulk", "METATRANSCRIPTOMIC": "metatranscriptomic"}
PLATFORMS = {
    "ILLUMINA": "illumina", "OXFORD_NANOPORE": "ont", "PACBIO_SMRT": "pacbio", "BGISEQ": "bgi", "DNBSEQ": "bgi",
    "ION_TORRENT": "ion_torrent", "ABI_SOLID": "legacy", "LS454": "legacy", "COMPLETE_GENOMICS": "legacy",
    "ELEMENT": "element", "VELA_DIAGNOSTICS": "legacy",
}
SELECTIONS = {
    "cDNA_oligo_dT": "poly_a", "Oligo-dT": "poly_a", "PolyA": "poly_a", "cDNA_randomPriming": "random_priming",
    "RANDOM": "random_priming", "RANDOM PCR": "random_priming", "PCR": "random_priming", "Inverse rRNA": "rrna_depletion",
    "CAGE": "cage", "cDNA": "cdna_unspecified", "DNase": "dnase", "other": "other", "RACE": "other", "RT-PCR": "other",
    "Reduced Representation": "other", "size fractionation": "size_fractionation", "unspecified": "unknown",
}
#: model: (platform family, generation, short name)
INSTRUMENTS = {
    "454 GS FLX": ("legacy", "early", "454_gs_flx"),
    "454 GS FLX Titanium": ("legacy", "early", "454_gs_flx_titanium"),
    "AB 5500 Genetic Analyzer": ("legacy", "early", "ab_5500"),
    "AB SOLiD 3 Plus System": ("legacy", "early", "ab_solid_3_plus"),
    "AB SOLiD System 3.0": ("legacy", "early", "ab_solid_3"),
    "BGISEQ-500": ("bgi", "bgi", "bgiseq_500"),
    "DNBSEQ-G400": ("bgi", "bgi", "dnbseq_g400"),
    "DNBSEQ-G50": ("bgi", "bgi", "dnbseq_g50"),
    "DNBSEQ-T7": ("bgi", "bgi", "dnbseq_t7"),
    "MGISEQ-2000RS": ("bgi", "bgi", "mgiseq_2000rs"),
    "Complete Genomics": ("legacy", "early", "complete_genomics"),
    "Element AVITI": ("element", "element", "element_aviti"),
    "GridION": ("ont", "ont", "gridion"),
    "MinION": ("ont", "ont", "minion"),
    "PromethION": ("ont", "ont", "promethion"),
    "Illumina Genome Analyzer": ("illumina", "early_illumina", "ga"),
    "Illumina Genome Analyzer II": ("illumina", "early_illumina", "ga_ii"),
    "Illumina Genome Analyzer IIx": ("illumina", "early_illumina", "ga_iix"),
    "Illumina HiScanSQ": ("illumina", "early_illumina", "hiscansq"),
    "Illumina HiSeq 1000": ("illumina", "hiseq_era", "hiseq_1000"),
    "Illumina HiSeq 1500": ("illumina", "hiseq_era", "hiseq_1500"),
    "Illumina HiSeq 2000": ("illumina", "hiseq_era", "hiseq_2000"),
    "Illumina HiSeq 2500": ("illumina", "hiseq_era", "hiseq_2500"),
    "Illumina HiSeq 3000": ("illumina", "hiseq_era", "hiseq_3000"),
    "Illumina HiSeq 4000": ("illumina", "hiseq_era", "hiseq_4000"),
    "HiSeq X Five": ("illumina", "hiseq_era", "hiseq_x_five"),
    "HiSeq X Ten": ("illumina", "hiseq_era", "hiseq_x_ten"),
    "Illumina HiSeq X": ("illumina", "hiseq_era", "hiseq_x"),
    "Illumina HiSeq X Ten": ("illumina", "hiseq_era", "hiseq_x_ten"),
    "Illumina MiSeq": ("illumina", "miseq", "miseq"),
    "Illumina MiniSeq": ("illumina", "miseq", "miniseq"),
    "Illumina iSeq 100": ("illumina", "miseq", "iseq_100"),
    "NextSeq 500": ("illumina", "nextseq", "nextseq_500"),
    "NextSeq 550": ("illumina", "nextseq", "nextseq_550"),
    "NextSeq 2000": ("illumina", "nextseq_v2", "nextseq_2000"),
    "Illumina NovaSeq 6000": ("illumina", "novaseq_era", "novaseq_6000"),
    "Illumina NovaSeq X": ("illumina", "novaseq_era", "novaseq_x"),
    "Illumina NovaSeq X Plus": ("illumina", "novaseq_era", "novaseq_x_plus"),
    "Ion Torrent PGM": ("ion_torrent", "ion_torrent", "ion_pgm"),
    "Ion Torrent Proton": ("ion_torrent", "ion_torrent", "ion_proton"),
    "Ion Torrent S5": ("ion_torrent", "ion_torrent", "ion_s5"),
    "PacBio RS": ("pacbio", "pacbio_early", "pacbio_rs"),
    "PacBio RS II": ("pacbio", "pacbio_early", "pacbio_rs_ii"),
    "Sequel": ("pacbio", "pacbio_modern", "sequel"),
    "Sequel II": ("pacbio", "pacbio_modern", "sequel_ii"),
    "Sentosa SQ301": ("legacy", "early", "sentosa_sq301"),
}

SINGLE_CELL = ["10x", "marsseq", "smartseq", "dropseq", "droncseq", "celseq", "indrops", "matqseq", "quartzseq", "splitseq", "scirnaseq", "microwellseq", "cytoseq", "seqwell", "fluidigm", "icell8", "strtseq", "sortseq", "scartrace", "scslamseq"]
BULK = ["bulk", "detct", "slamseq"]
THREE_PRIME = ["10x", "celseq", "marsseq", "dropseq", "droncseq", "indrops", "lexogen", "quartzseq", "cytoseq"]
FULL_LENGTH = ["smartseq", "fluidigm"]
PAIRED = ["10x", "dropseq", "droncseq", "marsseq", "celseq", "indrops", "splitseq", "scirnaseq"]
#: technology: class
CLASSES = {
    "10x": "single_cell_droplet",
    "dropseq": "single_cell_droplet",
    "indrops": "single_cell_droplet",
    "droncseq": "single_cell_droplet",
    "smartseq": "single_cell_plate",
    "fluidigm": "single_cell_plate",
    "celseq": "single_cell_plate",
    "marsseq": "single_cell_plate",
    "quartzseq": "single_cell_plate",
    "scirnaseq": "single_cell_plate",
    "splitseq": "single_cell_plate",
    "microwellseq": "single_cell_plate",
    "strtseq": "single_cell_plate",
    "cytoseq": "single_cell_plate",
    "seqwell": "single_cell_plate",
    "icell8": "single_cell_plate",
    "matqseq": "single_cell_plate",
    "superseq": "single_cell_plate",
    "generic-scrnaseq-only": "single_cell_generic",
    "bulk": "bulk",
    "detct": "bulk",
    "slamseq": "bulk",
    "scslamseq": "single_cell_plate",
    "iclip": "clip",
    "scartrace": "other_seq",
    "454": "other_seq",
    "unknown": "unknown",
}
#: Columns that several patterns add up to: at a tie they come behind all others, in this order.
MERGED = ["10x", "generic-scrnaseq", "smartseq", "trueseq", "lexogen"]

#: (column, pattern, edits allowed); patterns of one column add up.
TECHNOLOGIES = [
    ("bulk", r"\bbulk\b.{0,40}(?:rna|transcriptom|seq)|\btotal\s+rna\b.{0,30}librar", 1),
    ("10x", r"\b10[xX]\b.{0,20}(?:master\s*mix|barcode)|\b10[xX]\b.{0,60}(?:genomics|chromium|single.cell|[Gg][Ee][Mm]s?|v[23]|gene.express|flex|multiome)|(?:chromium|genomics).{0,60}\b10[xX]\b", 0),
    ("10x", r"chromium", 1),
    ("10x", r"Gel Bead Kit V3", 1),
    ("droncseq", r"dronc[-_ ]?seq", 1),
    ("dropseq", r"(?<![Uu]nlike )(?<![Cc]ompared to )\bdrop[-_ ]?seq(?!\s+[Tt]ools)", 0),
    ("fluidigm", r"fluidigm", 1),
    ("indrops", r"indrops?", 1),
    ("marsseq", r"\bmars[-_ ]?seq", 1),
    ("matqseq", r"matq[-_ ]?seq", 1),
    ("quartzseq", r"quartz[-_ ]?seq", 1),
    ("smartseq", r"smart[-_ ]?seq[234]", 1),
    ("smartseq", r"smart template[- ]switching", 1),
    ("smartseq", r"SMARTSeq\s+v[._ ]?\d|clontech.{0,25}smart[-_ ]?seq(?!\s*ultra)", 0),
    ("smartseq", r"smart[-_ ]?seq\s*(?:TM|™)", 0),
    ("smartseq", r"smart[-_ ]?seq\s*[®™]?\s*v[234]|SMART-Seq\s+v[234]", 1),
    ("detct", r"\bdetct\b|DeTCT", 0),
    ("scslamseq", r"\bsc[-_ ]?slam[-_ ]?seq\b", 0),
    ("slamseq", r"(?<![Ss][Cc][-_ ]?)\bslam[-_ ]?seq\b|4-thiouridine|s4U.{0,20}label", 0),
    ("splitseq", r"split[-_ ]?seq", 1),
    ("superseq", r"super[-_ ]?seq", 1),
    ("microwellseq", r"microwell[-_ ]?seq", 1),
    ("scirnaseq", r"sci[-_ ]?rna[-_ ]?seq3?", 0),
    ("celseq", r"cel[-_]?seq", 0),
    ("cytoseq", r"cyto[-_ ]?seq", 0),
    ("seqwell", r"seq[-_ ]?well", 0),
    ("strtseq", r"strt[-_ ]?seq", 0),
    ("sortseq", r"sort[-_ ]?seq", 0),
    ("icell8", r"icell8", 0),
    ("iclip", r"iclip", 0),
    ("454", r"\b((LS|Roche )454|454 FLX)\b", 0),
    ("scartrace", r"scartrace", 0),
    ("generic-scrnaseq", r"sc[-_ ]?RNA[-_ ]?seq", 0),
    ("generic-scrnaseq", r"single[-_ ]?cell[-_ ]?(RNA[-_ ])?seq(uencing)?", 1),
    ("generic-scrnaseq", r"scslam[-_ ]?seq", 0),
]
KITS = [
    ("trueseq", r"\btrue?.?seq\b", 0),
    ("trueseq", r"illumina.{0,30}(strand|total.rna|mrna.kit)", 1),
    ("nebnext", r"neb.?next", 0),
    ("nextera", r"\bnextera\b", 0),
    ("lexogen", r"lexogen", 0),
    ("lexogen", r"\bquant.?seq\b", 0),
    ("ribozero", r"ribo.?zero", 0),
    ("smarter", r"\bSMARTer\b", 0),
]
BIASES = [
    ("bias_3prime", r"3['’ʼ].{0,30}(gene|express|end|fwd|forward)|quantseq.{0,20}(3|fwd|forward)|3prime", 0),
    ("bias_5prime", r"5['’ʼ].{0,30}(gene|express|end|vdj)|vdj.{0,20}5['’ʼ]|five.{0,5}prime.{0,30}(end|capture)", 0),
    ("bias_fullength", r"full.?length|whole.{0,15}transcript|SMARTer", 0),
    ("stranded", r"strand.?specific|directional|\bstranded\b(?!.*un)", 0),
    ("unstranded", r"unstranded|non.?stranded", 0),
]
HINTS = [
    ("poly_a", r"\bpoly[- _]?a\b|\bpolya\b|oligo.?[dD][tT]|mrna.*select|select.*mrna", 0),
    ("rrna_depletion", r"ribo.?zero|rrna.depl|deplete.*ribo|inverse.rrna", 1),
    ("random_priming", r"random.*prim|random.*hexamer|whole.*transcr", 0),
    ("small_rna", r"small.?rna|\bmirna\b|microrna|\btrna\b|18.30.nt", 0),
]
#: What a match counts for at each level.
WEIGHTS = {"run": 1000, "sample": 100, "experiment": 10, "study": 1, "dataproc": 10}
