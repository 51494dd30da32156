"""Word lists and rules of the core, with our own vocabulary; all are parameters of the operators."""

from __future__ import annotations

# Words that carry no weight in sentence similarity.
STOP_WORDS = tuple(
    """i me my we our you your he him his she her they them what which who this that these those am is are was were be been being have has had do does did a an the and but if or as at by for with about of to from
    in out on up it its so than too very can will just not also into through during such then when where how all each both more most other same no nor only own here there over under again""".split()
)
# Words that carry no weight in the clustering of abstracts.
CLUSTER_STOPS = tuple(
    """i me my myself we our ours ourselves you your yours he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now using used use""".split()
)
# Parts of headings and their sections; the first rule that occurs wins, so the order matters.
HEADING_RULES = (
    ("abstract", "abstract"), ("summary", "abstract"), ("introduction", "introduction"), ("background and motivation", "introduction"), ("motivation", "introduction"), ("overview", "introduction"),
    ("theoretical background", "background"), ("preliminaries", "background"), ("preliminary", "background"), ("background", "background"), ("related work", "related_work"), ("prior work", "related_work"),
    ("literature review", "related_work"), ("previous work", "related_work"), ("state of the art", "related_work"), ("related", "related_work"), ("problem formulation", "problem_definition"),
    ("problem definition", "problem_definition"), ("problem statement", "problem_definition"), ("task definition", "problem_definition"), ("formulation", "problem_definition"),
    ("materials and methods", "methodology"), ("methods and materials", "methodology"), ("proposed method", "methodology"), ("proposed approach", "methodology"), ("our approach", "methodology"),
    ("our method", "methodology"), ("approach", "methodology"), ("methodology", "methodology"), ("method", "methodology"), ("model", "methodology"), ("architecture", "methodology"), ("framework", "methodology"),
    ("system design", "methodology"), ("technical approach", "methodology"), ("algorithm", "methodology"), ("acoustic", "methodology"), ("feature extraction", "methodology"), ("mathematical", "methodology"),
    ("proof", "methodology"), ("implementation", "methodology"), ("dataset", "dataset"), ("data collection", "dataset"), ("data", "dataset"), ("corpus", "dataset"), ("benchmark dataset", "dataset"),
    ("experimental results", "results"), ("quantitative result", "results"), ("qualitative result", "results"), ("performance analysis", "results"), ("result", "results"), ("finding", "results"),
    ("ablation study", "results"), ("ablation", "results"), ("case study", "results"), ("experimental setup", "experiments"), ("experimental settings", "experiments"), ("experimental evaluation", "experiments"),
    ("experiments and results", "experiments"), ("experiment", "experiments"), ("evaluation setup", "experiments"), ("evaluation", "experiments"), ("implementation detail", "experiments"), ("setup", "experiments"),
    ("training", "experiments"), ("performance", "results"), ("analysis", "results"), ("comparison", "results"), ("discussion and conclusion", "discussion"), ("discussion", "discussion"),
    ("interpretation", "discussion"), ("limitations and future work", "limitations"), ("limitation", "limitations"), ("shortcoming", "limitations"), ("weakness", "limitations"), ("failure case", "limitations"),
    ("future work", "future_work"), ("future direction", "future_work"), ("open problem", "future_work"), ("future research", "future_work"), ("future", "future_work"), ("conclusion and future", "conclusion"),
    ("concluding remark", "conclusion"), ("conclusion", "conclusion"), ("summary and conclusion", "conclusion"), ("closing remark", "conclusion"), ("appendix", "methodology"),
    ("supplementary analysis", "methodology"), ("references", "references"), ("bibliography", "bibliography"), ("works cited", "references"), ("literature cited", "references"),
    ("acknowledgment", "acknowledgments"), ("acknowledgement", "acknowledgments"), ("funding", "funding"), ("financial support", "funding"), ("grant support", "funding"),
    ("conflict of interest", "conflict_of_interest"), ("competing interest", "conflict_of_interest"), ("declaration of competing interest", "conflict_of_interest"),
    ("financial disclosure", "conflict_of_interest"), ("author contribution", "author_contributions"), ("authors' contribution", "author_contributions"), ("authors contributions", "author_contributions"),
    ("data availability", "acknowledgments"), ("ethics statement", "acknowledgments"), ("declaration", "acknowledgments"), ("supplementary material", "supplementary_material"),
    ("supporting information", "supplementary_material"),
)
# Headings that name two sections.
COMBINED_RULES = (("limitations and future work", "limitations", "future_work"), ("conclusion and future work", "conclusion", "future_work"), ("discussion and conclusion", "discussion", "conclusion"), ("experiments and results", "experiments", "results"))
NON_RESEARCH = ("references", "bibliography", "acknowledgments", "funding", "conflict_of_interest", "author_contributions", "supplementary_material")
# Sections in reading order, their weights and bounds.
SECTION_ORDER = ("abstract", "introduction", "background", "related_work", "problem_definition", "methodology", "dataset", "experiments", "results", "discussion", "limitations", "future_work", "conclusion", "unknown")
SECTION_WEIGHT = {"abstract": 1.0, "introduction": 1.0, "background": 0.9, "related_work": 0.8, "problem_definition": 0.9, "methodology": 1.3, "dataset": 1.1, "experiments": 1.2, "results": 1.3, "discussion": 1.0, "limitations": 1.1, "future_work": 0.8, "conclusion": 0.9, "unknown": 0.9}
OTHER_WEIGHT = 1.0
MIN_SENTENCES = {"methodology": 3, "introduction": 2, "background": 2, "related_work": 2, "experiments": 2, "results": 2, "discussion": 2, "unknown": 2}
OTHER_MIN = 1
# a label that is not listed has the bound of unknown
MAX_SENTENCES = dict.fromkeys(SECTION_ORDER, 1000) | {"abstract": 50, "methodology": 2000, "experiments": 2000, "results": 2000, "unknown": 2000}
# What marks the entries of a bibliography, research prose and the classes of sections without a known heading.
REFERENCE_HEADINGS = ("reference", "bibliography", "works cited", "literature cited")
REFERENCE_MARKS = ("doi:", "doi.org", "proceedings of", "in proc.", "vol.", "pp.", "isbn")
RESEARCH_PROSE = ("we propose", "we evaluate", "in this section", "our method", "the model", "results show", "table", "figure", "accuracy", "performance", "we find", "demonstrates")
FUNDING_PHRASES = ("this work was supported by", "funded by", "grant number", "grant no.", "financial support", "under award number", "supported by grant")
CONFLICT_PHRASES = ("conflict of interest", "competing interest", "declare no conflict")
CONTRIBUTION_PHRASES = ("author contribution", "authors' contribution", "conceived and designed the experiments")
THANKS_PHRASES = ("we thank", "the authors thank", "data availability statement", "ethics approval", "received: ", "accepted: ", "published online", "copyright:", "all rights reserved")
# Letters beyond ASCII count as letters at word boundaries; they are replaced by one before rules are applied.
WIDE_LETTERS = "[ªµºÀ-ɏͰ-῿぀-鿿가-힯０-ￜ]"
# Signs of technical content and their weights; regular expressions on lower-case text.
TECHNICAL_RULES = (
    # names of measures
    (r"\b(accuracy|acc)\b", 0.5), (r"\b(f1[_\s-]?score|f1)\b", 0.6), (r"\b(precision|recall)\b", 0.5), (r"\b(auroc|auc|roc)\b", 0.6), (r"\b(bleu|rouge[_\s-]?\d?|meteor|cider)\b", 0.6), (r"\b(perplexity|ppl)\b", 0.6),
    (r"\b(rmse|mae|mse|mape)\b", 0.6), (r"\b(map|ndcg|mrr|hit@\d)\b", 0.6), (r"\b(em|exact\s+match)\b", 0.5),
    # comparisons
    (r"\b(outperform|surpass|exceed|improve|achieve|obtain|attain)\b", 0.3), (r"\b(state[_\s-]of[_\s-]the[_\s-]art|sota)\b", 0.5), (r"\b(baseline|benchmark)\b", 0.4),
    (r"\b(reduction|decrease|increase|improvement|gain|drop)\b", 0.3), (r"\b(significant|substantially|notably|considerably)\b", 0.2), (r"\b(best|top|highest|lowest|optimal|superior)\b", 0.2),
    (r"\b(comparison|compared|vs\.?|versus|outperf)\b", 0.3), (r"\b(ablation)\b", 0.5),
    # numbers
    (r"\d+\.?\d*\s*%", 0.5), (r"\b\d+\.\d+\b", 0.3), (r"\b\d{2,}\s*(million|billion|thousand|k|m|b)\b", 0.4), (r"\b\d+\s*(ms|seconds|minutes|hours)\b", 0.4), (r"\b\d+\s*(gb|mb|kb|gib|mib)\b", 0.4), (r"\b\d+x\b", 0.3),
    # settings of experiments
    (r"\b(learning\s+rate|lr)\b", 0.4), (r"\b(batch\s+size|mini[_\s-]batch)\b", 0.4), (r"\b(epoch[s]?|iteration[s]?)\b", 0.3), (r"\b(dropout|weight\s+decay|regularization)\b", 0.3),
    (r"\b(optimizer|adam|sgd|adagrad|rmsprop)\b", 0.4), (r"\b(training\s+time|inference\s+time|latency)\b", 0.5), (r"\b(gpu|cpu|tpu|cuda|hardware)\b", 0.3), (r"\b(parameter[s]?|weights?)\b", 0.3), (r"\b(flop[s]?|gflop[s]?|tflop[s]?)\b", 0.5),
    # data
    (r"\b(dataset|corpus|benchmark|collection)\b", 0.4), (r"\b(imagenet|cifar[_-]?\d+|coco|voc|mnist|squad|glue|superglue)\b", 0.6), (r"\b(pubmed|mimic|chexpert|nihcc|nlm)\b", 0.5),
    (r"\b(wikipedia|bookcorpus|openwebtext|pile)\b", 0.5), (r"\b(train(ing)?|val(idation)?|test)\s+set\b", 0.3), (r"\b\d+[,\d]*\s+(samples?|examples?|instances?|records?|images?|tokens?)\b", 0.4),
    # models
    (r"\b(bert|gpt|t5|roberta|xlnet|albert|deberta|electra)\b", 0.5), (r"\b(transformer|attention|self[_\s-]attention|multi[_\s-]head)\b", 0.4), (r"\b(lstm|gru|rnn|cnn|resnet|vgg|vit|densenet)\b", 0.5),
    (r"\b(gan|vae|diffusion|stable\s+diffusion|ddpm)\b", 0.5), (r"\b(llm|large\s+language\s+model|foundation\s+model)\b", 0.5), (r"\b(reinforcement\s+learning|rl|ppo|dqn|a3c)\b", 0.5),
    (r"\b(contrastive|clip|simclr|byol|moco)\b", 0.5),
    # limits and outlook
    (r"\b(limitation|limit|constrain|restrict|bottleneck)\b", 0.4), (r"\b(future\s+work|future\s+direction|future\s+research)\b", 0.5), (r"\b(open\s+problem|open\s+question|unresolved|unsolved)\b", 0.4),
    (r"\b(scalab(le|ility)|generaliz(e|ation|ability)|transfer)\b", 0.4), (r"\b(failure\s+(case|mode)|weakness|shortcoming)\b", 0.4),
    # statistics
    (r"\bp\s*[<=>≤≥]\s*0\.\d+", 0.7), (r"\bp[_\s-]?value", 0.6), (r"\b(confidence\s+interval|ci)\b", 0.6), (r"\b(mean\s*[±+\-]\s*sd|mean\s*[±+\-]\s*se)\b", 0.6), (r"\b(standard\s+deviation|standard\s+error|sd|se)\b", 0.4),
    (r"\b(odds\s+ratio|hazard\s+ratio|relative\s+risk|risk\s+ratio)\b", 0.6), (r"\b(r\s*=\s*[\d.]+|r\s*²|r-squared|pearson|spearman)\b", 0.6), (r"\b(regression|correlation|coefficient|beta\s+coefficient)\b", 0.4),
    (r"\b(anova|ancova|t-test|chi-?square|mann.?whitney|kruskal.?wallis)\b", 0.6), (r"\b(statistical(ly)?\s+significant|significance|non-significant)\b", 0.5), (r"\b(sample\s+size|n\s*=\s*\d+|n\s*=\s*\d+)\b", 0.5),
    (r"\b(effect\s+size|cohen.?s\s+d|eta.?squared|omega.?squared)\b", 0.6),
    # ecology
    (r"\b(species\s+richness|biodiversity|alpha\s+diversity|beta\s+diversity)\b", 0.6), (r"\b(shannon|simpson|chao|rarefaction|species\s+abundance)\b", 0.6), (r"\b(habitat|ecosystem|biome|ecotone|niche|trophic)\b", 0.4),
    (r"\b(biomass|abundance|density|cover|canopy)\b", 0.4), (r"\b(population\s+(size|growth|decline)|demographic)\b", 0.5), (r"\b(community\s+(composition|structure)|assemblage)\b", 0.5),
    (r"\b(functional\s+(trait|diversity|group))\b", 0.5), (r"\b(invasive\s+species|native\s+species|endemic|threatened|endangered)\b", 0.5), (r"\b(climate\s+change|temperature|precipitation|drought|flood)\b", 0.4),
    (r"\b(carbon\s+(stock|sequestration|flux)|nitrogen|nutrient\s+cycle)\b", 0.5), (r"\b(plot|transect|quadrat|survey\s+site|sampling\s+(unit|plot|area))\b", 0.4),
    (r"\b(land\s+(use|cover)|deforestation|fragmentation|corridor)\b", 0.4), (r"\b(pollinator|seed\s+dispersal|predator|prey|herbivory)\b", 0.4), (r"\b(phylogenetic|evolutionary|divergence|speciation)\b", 0.5),
    # medicine
    (r"\b(mortality|morbidity|incidence|prevalence|risk\s+factor)\b", 0.5), (r"\b(clinical\s+trial|randomized|placebo|double.blind)\b", 0.6), (r"\b(sensitivity|specificity|positive\s+predictive|negative\s+predictive)\b", 0.6),
    (r"\b(dosage|dose|mg\s*/\s*kg|mg\s*/\s*day|pharmacokinetic)\b", 0.5), (r"\b(biomarker|gene\s+expression|protein\s+level|sequencing)\b", 0.5), (r"\b(survival\s+(rate|analysis|curve)|kaplan.?meier)\b", 0.6),
    # physics and engineering
    (r"\b(wavelength|frequency|amplitude|resonance|impedance)\b", 0.4), (r"\b(temperature|pressure|viscosity|density|conductivity)\b", 0.4), (r"\b(yield|purity|conversion|selectivity|efficiency)\b", 0.4),
    (r"\b(tensile\s+strength|young.s\s+modulus|hardness|elasticity)\b", 0.5),
)
# What an error page, a landing page, a publisher's wrapper, a research text and a missing abstract look like.
ERROR_PHRASES = (
    "404 not found", "access denied", "permission denied", "cookie policy", "please enable javascript", "please enable cookies", "sign in to access", "purchase this article", "subscribe to continue", "cloudflare",
    "attention required", "verify you are human", "captcha", "just a moment...", "service unavailable", "bad gateway", "gateway timeout", "no abstract available", "doi landing page", "citation only",
)
LANDING_PHRASES = ("download citation", "rights and permissions", "about this article", "cite this article", "share this article")
WRAPPER_WORDS = ("publisher", "journal", "volume", "citation", "metrics", "download", "cookie", "policy", "terms", "privacy", "copyright", "advertisement")
DISCOURSE = (
    "method", "result", "experiment", "model", "analysis", "dataset", "accuracy", "evaluate", "performance", "approach", "proposed", "study", "table", "figure", "we find", "we demonstrate", "we propose",
    "in this paper", "investigate", "speech", "detection", "neural", "network", "algorithm", "multi-agent",
)
NO_ABSTRACT = ("no abstract available", "abstract not provided", "abstract not available", "n/a")
# Anchors of one topic. match: word or substring.
TOPIC = "retrieval over patent and research corpora"
ANCHORS = (
    ("core", "retrieval", "word"), ("core", "index", "word"), ("core", "corpus", "word"), ("core", "query", "word"), ("mechanism", "encoder", "word"), ("mechanism", "ranker", "word"), ("mechanism", "graph", "word"),
    ("mechanism", "classifier", "word"), ("exclude", "orchard", "word"), ("exclude", "glacier", "word"), ("exclude", "tyre", "word"),
)
# What shows that a work has an aim of its own.
OBJECTIVE_CUES = ("propose", "survey", "introduce", "we evaluate", "we demonstrate", "we develop", "architecture", "methodology", "algorithm")
GENERIC_TOPIC_WORDS = ("over", "and", "the", "for", "with", "using", "research", "study")
# Words that announce a limit, in selected sentences and in running text.
EVIDENCE_CUES = ("limit", "lack", "restrict", "challenge", "however", "bottleneck", "drawback", "future")
LIMIT_WORDS = ("limit", "lack", "suffer", "restrict", "challenge", "however", "although", "but", "bottleneck", "drawback", "missing")
SEVERITIES = ("Critical", "Moderate", "Low")


def anchors(group: str) -> list[str]:
    return [a for g, a, _ in ANCHORS if g == group]
