"""Fixed values. They must equal the published ones for right results, so they are stated plainly."""

# Retired subject codes and the codes that replaced them.
LEGACY_CODES = {
    "cmp-lg": "cs.CL",
    "alg-geom": "math.AG",
    "dg-ga": "math.DG",
    "funct-an": "math.FA",
    "q-alg": "math.QA",
    "mtrl-th": "cond-mat.mtrl-sci",
    "supr-con": "cond-mat.supr-con",
    "chao-dyn": "nlin.CD",
    "comp-gas": "nlin.CG",
    "patt-sol": "nlin.PS",
    "solv-int": "nlin.SI",
    "adap-org": "nlin.AO",
    "acc-phys": "physics.acc-ph",
    "ao-sci": "physics.ao-ph",
    "atom-ph": "physics.atom-ph",
    "chem-ph": "physics.chem-ph",
    "bayes-an": "physics.data-an",
    "plasm-ph": "physics.plasm-ph",
}

# Subject codes that are folded into one "no label" class.
UNLABELLED_CODES = [
    "stat.AP",
    "stat.OT",
    "stat.CO",
    "q-fin.MF",
    "q-fin.CP",
    "q-fin.EC",
    "q-bio",
    "q-bio.QM",
    "q-bio.OT",
    "q-bio.SC",
    "q-bio.TO",
    "physics.data-an",
    "econ.GN",
    "econ.TH",
    "Engineering",
    "cs.CE",
]

# Subject names accepted from a stored paper page.
PAGE_FIELDS = [
    "Medicine",
    "Biology",
    "Chemistry",
    "Engineering",
    "Computer Science",
    "Physics",
    "Materials Science",
    "Mathematics",
    "Psychology",
    "Economics",
    "Political Science",
    "Business",
    "Geology",
    "Sociology",
    "Geography",
    "Environmental Science",
    "Art",
    "History",
    "Philosophy",
]

# Local name of a predicate -> column of the paper table.
PAPER_PREDICATES = {
    "P26": "doi",
    "P27": "author",
    "P28": "publication_month",
    "P29": "publication_year",
    "rdf-schema#label": "title",
    "HAS_VENUE": "publisher",
    "url": "url",
}
FIELD_PREDICATE = "P30"

PLACEHOLDER_LABEL = "Science"
NO_LABEL = "nolabel"

# English stop words (the usual list of 179).
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't
""".split()

# Settings of the published run.
TRAIN_SHARE = 0.7
REQUEST_LIMIT = 100
REQUEST_SPAN_SECONDS = 300
SGD_ALPHA = 1e-7
SGD_TOL = 1e-6
SGD_MAX_ITER = 1000
TUNE_TOL = (1e-7, 1e-2)
TUNE_ALPHA = (1e-8, 0.1)
TUNE_TRIALS = 4
TUNE_MAX_ITER = 20
SENTENCES_PER_TEXT = {"title": 1, "title_publisher": 2, "title_abstract": 10}
SENTENCE_DIM = 512
