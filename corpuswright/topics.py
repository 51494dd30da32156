"""Topics: from a topic string to its kind, its anchors and its search strings.

A topic is one of three known kinds or a general one; literature and patents have anchor lists of their own.
:func:`literature_topic` and :func:`patent_topic` serve one topic at plan time; :func:`normalised`,
:func:`topic_kind` and :func:`search_strings` do the same for a column of topics, inside codegen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MULTI_AGENT, DEEPFAKE, SEGMENTATION, GENERAL = "MULTI_AGENT_AI", "DEEPFAKE_AUDIO", "MEDICAL_IMAGE_SEGMENTATION", "GENERAL_DOMAIN"

# Misspellings of topic strings.
SPELLING = (
    ("intelligience", "intelligence"), ("intellegence", "intelligence"), ("intellegience", "intelligence"), ("artifical", "artificial"), ("barificial", "artificial"),
    ("segmetation", "segmentation"), ("segmentatn", "segmentation"), ("reinfocement", "reinforcement"), ("reinforment", "reinforcement"), ("deeepfake", "deepfake"),
    ("deep-fak", "deepfake"), ("autonomus", "autonomous"), ("colaboration", "collaboration"), ("coordinatn", "coordination"), ("architecure", "architecture"),
)
# Words that carry no topic, in a topic string.
TOPIC_STOPS = ("and", "for", "the", "with", "using", "of", "in", "on", "a", "an", "via", "to", "from", "by", "at", "or", "as", "is", "are", "into")
# What makes a topic one of the known kinds, in literature and in patents; the first kind that fits wins.
LITERATURE_TRIGGERS = (
    (MULTI_AGENT, ("multi agent", "multi-agent", "multiagent", "multi agents", "multi-agents", "agentic", "ai agent", "ai agents", "intelligent agent", "software agent", "autonomous agent")),
    (DEEPFAKE, ("deepfake", "audio spoof", "voice spoof", "synthetic speech", "audio fake", "voice forgery", "audio forgery", "synthetic voice")),
    (SEGMENTATION, ("medical image", "segmentation", "mri", "ct scan", "ultrasound", "tumor", "lesion", "radiology", "biomedical image", "contouring")),
)
PATENT_TRIGGERS = (
    (MULTI_AGENT, ("multi agent", "multi-agent", "multiagent", "agentic", "ai agent", "ai agents", "intelligent agent", "software agent", "autonomous agent", "large language model", "llm", "language model")),
    (DEEPFAKE, ("deepfake", "audio spoof", "voice spoof", "synthetic speech", "audio fake", "voice forgery", "audio forgery", "synthetic voice")),
    (SEGMENTATION, ("medical image", "segmentation", "mri", "ct scan", "ultrasound", "tumor", "lesion", "radiology", "biomedical image")),
)
# What makes several agents a must.
SEVERAL_AGENTS = ("multi agent", "multi-agent", "multiagent", "multi agents", "multi-agents", "multiple agent", "multiple intelligent agents", "agent coordination", "agent collaboration")
SEVERAL_AGENTS_PATENT = ("multi agent", "multiagent", "multi-agent", "multi-agent systems", "multiagent systems", "multiple agent")

# Anchors of the literature topics.
LITERATURE_ANCHORS = {
    MULTI_AGENT: {
        "domain": ("artificial intelligence", "ai", "machine learning", "deep learning", "reinforcement learning", "neural network", "neural networks", "intelligent systems", "distributed artificial intelligence", "dai"),
        "core_several": (
            "multi-agent", "multi agent", "multiagent", "multi-agent system", "multiagent system", "multi-agent systems", "multiagent systems", "multiple intelligent agents", "multiple agents",
            "collaborative agents", "distributed agents", "agent society", "agent swarm", "multi-agent AI", "multi-agent learning", "multi-agent reinforcement learning", "marl",
        ),
        "core_single": ("ai agent", "ai agents", "intelligent agent", "intelligent agents", "software agent", "software agents", "autonomous agent", "agentic ai", "agentic", "autonomous software agent", "agent-based system"),
        "mechanism": (
            "agent coordination", "agent collaboration", "agent communication", "agent interaction", "agent negotiation", "agent orchestration", "agent planning", "agent delegation", "agent strategy",
            "multi-agent reinforcement learning", "marl", "multi-agent learning", "distributed decision making", "game theory", "consensus protocol", "inter-agent communication", "cooperative learning",
            "strategy prediction", "cooperative agents", "distributed artificial intelligence",
        ),
        "agent": ("ai agent", "ai agents", "intelligent agent", "software agent", "autonomous agent", "agentic", "llm agent"),
        "several": (
            "multi-agent", "multi agent", "multiagent", "multi-agent system", "multiagent system", "multi-agent systems", "multiagent systems", "multiple intelligent agents", "multiple agents",
            "collaborative agents", "distributed agents", "agent coordination", "agent collaboration", "agent communication", "agent interaction", "agent negotiation", "agent orchestration",
            "multi-agent learning", "multi-agent reinforcement learning", "marl", "distributed artificial intelligence", "cooperative agents", "cooperating agents",
        ),
        "exclusion": (
            "sanctions on iran", "political economy", "macroeconomic", "petroleum", "autonomous robot", "autonomous vehicle", "telecommunications routing", "generic network routing",
            "physical autonomous machine", "travel agent", "chemical agent", "biological agent", "cleaning agent", "reagent", "fermi paradox", "astrophysics", "clinical scheduling without agents",
            "single-agent reinforcement learning",
        ),
        "generic": ("artificial intelligence", "ai", "intelligence", "system", "framework", "model", "data", "method", "process", "approach", "novel", "algorithm", "autonomous", "network", "agent"),
    },
    DEEPFAKE: {
        "domain": ("audio", "speech", "voice", "acoustic", "vocal", "sound", "phonetic", "utterance", "speaker", "waveform", "spectrogram", "audio signal", "speech signal", "voice biometric", "audio recording"),
        "core": (
            "deepfake", "deep-fake", "synthetic", "synthesized", "spoof", "spoofing", "forgery", "fake", "manipulation", "manipulated", "cloned", "cloning", "voice conversion", "text-to-speech", "tts",
            "replay attack", "tampered audio",
        ),
        "mechanism": (
            "detection", "detecting", "detect", "identifying", "classification", "classifier", "verification", "discriminator", "authenticating", "authenticity", "anti-spoofing", "liveness",
            "anomaly detection", "speaker verification against synthetic speech", "audio deepfake detection",
        ),
        "exclusion": (
            "breathing detection", "catheter tip", "cochlear implant", "intelligibility assessment", "speech sound intelligibility", "audio enhancement", "hearing aid", "stethoscope",
            "acoustic echo cancellation", "active noise control", "noise reduction", "facial image deepfake", "video face swap", "chemical forgery marker",
        ),
        "generic": ("audio", "sound", "signal", "system", "method", "device", "apparatus"),
    },
    SEGMENTATION: {
        "domain": (
            "medical", "clinical", "biomedical", "mri", "ct", "computed tomography", "ultrasound", "x-ray", "radiology", "radiograph", "histopathology", "anatomical", "organ", "tissue", "tumor", "lesion",
            "patient", "kidney", "brain", "cardiac", "lung", "liver", "diagnostic", "angiographic",
        ),
        "core": ("image", "imaging", "scan", "scans", "volume", "volumetric", "slice", "tomography", "radiological image", "biomedical image", "medical image", "angiogram", "mri scan"),
        "mechanism": (
            "segmentation", "segmenting", "segment", "segmented", "delineating", "delineation", "contouring", "region of interest", "roi", "mask", "boundary extraction", "lesion segmentation",
            "organ segmentation", "deep learning", "convolutional neural network", "u-net", "transformer",
        ),
        "exclusion": (
            "industrial robot", "robot arm", "welding", "automotive assembly", "wafer manufacturing", "drilling", "plasma etching", "medical image viewer without segmentation", "generic database indexing",
        ),
        "generic": ("medical", "image", "system", "method", "device", "process", "analysis"),
    },
}
GENERIC = ("system", "method", "process", "analysis", "approach")
# Anchors of the patent topics.
PATENT_ANCHORS = {
    MULTI_AGENT: {
        "ai": (
            "artificial intelligence", "machine learning", "deep learning", "neural network", "neural networks", "large language model", "llm", "llms", "foundation model", "generative ai",
            "generative artificial intelligence", "ai model", "machine-learning model", "reinforcement learning", "transformer", "nlp", "natural language processing", "deep neural",
            "convolutional neural", "algorithmic planning", "autonomous software",
        ),
        "agent": (
            "ai agent", "ai agents", "intelligent agent", "intelligent agents", "software agent", "software agents", "artificial intelligence agent", "machine learning agent", "llm agent", "agentic ai",
            "agentic", "agent-based software", "agent-based system", "autonomous software agent", "autonomous software agents", "agent architecture", "agent framework", "decision-making agent",
            "planning agent", "reasoning agent", "task agent",
        ),
        "several": (
            "multi-agent", "multiagent", "multi-agent system", "multiagent system", "multi-agent systems", "multiagent systems", "agent collaboration", "agent coordination", "agent communication",
            "agent negotiation", "agent delegation", "agent orchestration", "collaborative agents", "agent swarm", "distributed agents", "inter-agent", "agent interaction", "multiple ai agents",
            "multiple software agents", "multiagent coordination", "multi-agent coordination", "agent-to-agent", "agent planning",
        ),
        "telecom": ("tariff", "telecommunications network", "routing data via a communications network", "packet routing", "cellular base station", "telecom subscriber", "network routing"),
        "other_agents": (
            "travel agent", "chemical agent", "forgery agent", "biological agent", "marker agent", "contrast agent", "reagent", "patent agent", "cleaning agent", "solidifying agent", "therapeutic agent",
            "curing agent", "bleaching agent", "binding agent", "wetting agent", "anti-foaming agent", "chelating agent", "crosslinking agent", "gelling agent", "foaming agent", "thickening agent",
        ),
        "machines": ("caring for plants", "plant care", "lawn mower", "vacuum cleaner", "welding robot", "industrial robot"),
    },
    DEEPFAKE: {
        "audio": (
            "audio", "speech", "voice", "acoustic", "vocal", "sound", "phonetic", "utterance", "speaker", "waveform", "spectrogram", "audio signal", "speech signal", "voice biometric", "audio recording",
            "voice sample", "synthetic speech", "audio spoofing",
        ),
        "synthetic": (
            "deepfake", "deep-fake", "synthetic", "synthesized", "spoof", "spoofing", "forgery", "fake", "manipulation", "manipulated", "cloned", "cloning", "voice conversion", "text-to-speech", "tts",
            "replay", "tampered",
        ),
        "detection": (
            "detection", "detecting", "detect", "identifying", "classification", "classifier", "verification", "discriminator", "authenticating", "authenticity", "anti-spoofing", "liveness", "anomaly",
        ),
        "visual": (
            "facial image", "video frame", "face swap", "deepfake image", "image forgery", "optical image", "camera lens", "wafer inspection", "body abnormalities", "lie detection mat",
        ),
        "markers": ("marker agent", "bioluminescent", "forgery detection agent", "luminescent"),
        "security": (
            "voice biometric", "speaker verification", "anti-spoofing", "replay attack", "liveness", "tampered audio", "voice authentication", "audio authentication", "voice spoofing", "speech forgery",
            "synthetic speech", "synthetic voice",
        ),
        "plain_audio": (
            "breathing detection", "catheter tip", "cochlear implant", "intelligibility assessment", "speech sound intelligibility", "audio enhancement", "hearing aid", "stethoscope",
            "acoustic echo cancellation", "active noise control", "noise reduction", "loudspeaker", "volume control", "sound level meter", "audio codec", "audio compression",
        ),
    },
    SEGMENTATION: {
        "medical": (
            "medical", "clinical", "biomedical", "mri", "ct", "computed tomography", "ultrasound", "x-ray", "radiology", "radiograph", "histopathology", "anatomical", "organ", "tissue", "tumor", "lesion",
            "patient", "kidney", "brain", "cardiac", "lung", "liver", "diagnostic", "healthcare", "angiographic",
        ),
        "image": ("image", "imaging", "scan", "scans", "volume", "volumetric", "slice", "tomography", "radiological image", "biomedical image", "medical image", "angiogram"),
        "segmentation": (
            "segmentation", "segmenting", "segment", "segmented", "delineating", "delineation", "contouring", "region of interest", "roi", "mask", "boundary extraction", "lesion segmentation",
            "organ segmentation", "partitioning",
        ),
        "industrial": ("industrial robot", "robot arm", "welding", "automotive assembly", "wafer manufacturing", "drilling", "plasma etching"),
        "surely_medical": ("medical", "clinical", "mri", "patient", "tissue", "tumor"),
    },
}
# Search strings of the known kinds, behind the topic itself; at most ten in all.
LITERATURE_SEARCHES = {
    MULTI_AGENT: (
        "multi-agent artificial intelligence", "multi-agent systems", "multi-agent reinforcement learning", "multi-agent AI", "multiple intelligent agents", "agent coordination artificial intelligence",
        "agent collaboration artificial intelligence", "agent communication artificial intelligence", "distributed artificial intelligence multi-agent", "intelligent agents machine learning",
    ),
    DEEPFAKE: (
        "deepfake audio detection", "synthetic speech detection", "voice spoofing detection", "audio forgery detection", "synthetic voice verification", "speech deepfake detection neural network",
        "voice anti-spoofing classifier",
    ),
    SEGMENTATION: (
        "medical image segmentation deep learning", "mri segmentation deep learning", "ct scan organ segmentation", "tumor segmentation medical imaging", "anatomical structure segmentation neural network",
        "biomedical image segmentation u-net",
    ),
}
PATENT_SEARCHES = {
    MULTI_AGENT: (
        "multi-agent artificial intelligence", "multi-agent systems", "multi-agent AI", "multiple intelligent agents", "multi-agent reinforcement learning", "agent coordination artificial intelligence",
        "agent collaboration artificial intelligence", "intelligent agent machine learning", "multi-agent strategy prediction", "multi-agent decision making",
    ),
    DEEPFAKE: (
        "deepfake audio detection", "synthetic speech detection", "voice spoofing detection", "audio forgery detection", "synthetic voice verification", "speaker verification anti-spoofing",
        "deepfake voice detection system", "speech deepfake detection method",
    ),
    SEGMENTATION: (
        "medical image segmentation", "mri segmentation system", "neural image segmentation", "medical image diagnostic method", "anatomical organ segmentation", "brain tumor segmentation system",
    ),
}
GENERAL_SUFFIXES = {"literature": ("system", "method", "framework", "research"), "patent": ("system", "method", "apparatus", "device")}
# Synonyms that the live patent expansion adds: (triggers, strings), first fit wins; at most eight strings in all.
EXPANSIONS = (
    (("deepfake", "audio spoofing", "voice spoof", "synthetic speech", "audio fake"), ("voice spoofing detection", "synthetic speech detection", "audio forgery detection", "synthetic voice verification", "speaker verification anti-spoofing")),
    (("agentic", "multiagent", "multi-agent", "autonomous agent", "ai agent", "intelligent agent", "llm agent"), ("agentic AI", "ai agents", "multi-agent AI", "multi-agent systems", "autonomous AI agents", "multi-agent artificial intelligence", "AI agent orchestration", "large language model agents", "multi-agent LLM systems")),
    (("medical image", "segmentation", "mri", "tumor", "ct scan"), ("medical image segmentation", "mri segmentation system", "neural image segmentation", "medical image diagnostic method")),
    (("financial", "finance", "stock", "forecasting", "market"), ("financial forecasting model", "financial time series prediction", "market prediction system", "neural financial forecasting")),
)


@dataclass(frozen=True)
class Topic:
    """A topic with its kind, whether several agents are a must, and its anchors by group."""

    text: str
    normalised: str
    kind: str
    several: bool = False
    anchors: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __getitem__(self, group: str) -> tuple[str, ...]:
        return self.anchors.get(group, ())


def any_in(text: str, parts: tuple[str, ...]) -> bool:
    return any(p in text for p in parts)


def normalise_topic(topic: str | None) -> str:
    """The topic with known misspellings and orders corrected; the known fields get one canonical name."""
    raw = (topic or "").strip()
    low = raw.lower()
    for wrong, right in SPELLING:
        low = re.sub(rf"\b{wrong}\b", right, low)
    low = re.sub(r"\bintelligence\s+artificial\b", "artificial intelligence", low)
    for parts, name in canonical_names():
        if all(any_in(low, p) for p in parts):
            return name
    return raw


def canonical_names() -> tuple[tuple[tuple[tuple[str, ...], ...], str], ...]:
    """Fixed values: (groups of which each must occur, name), first fit wins."""
    several = ("multi agent", "multi agents", "multiagent")
    imaging = ("medical image", "segmentation")
    return (
        ((several, ("artificial intelligence", "ai")), "Multi-agent artificial intelligence"),
        ((several, ("reinforcement learning",)), "Multi-agent reinforcement learning"),
        ((several, ("llm", "language model")), "Multi-agent large language model systems"),
        ((several,), "Multi-agent systems"),
        ((("deepfake",), ("audio", "speech", "voice")), "Deepfake audio detection"),
        ((imaging, ("deep learning", "neural")), "Medical image segmentation using deep learning"),
        ((imaging,), "Medical image segmentation"),
    )


def topic_words(topic: str, least: int = 3) -> list[str]:
    """Words of a topic string that carry meaning, in order."""
    return [w for w in re.sub(r"[^a-zA-Z0-9\s\-]", " ", topic.lower()).split() if len(w) >= least and w not in TOPIC_STOPS]


def literature_topic(topic: str) -> Topic:
    name = normalise_topic(topic)
    low = name.lower()
    kind = next((k for k, parts in LITERATURE_TRIGGERS if any_in(low, parts)), GENERAL)
    if kind == GENERAL:
        words = tuple(topic_words(low))
        return Topic(topic, name, kind, False, {"domain": words[:4], "core": words, "mechanism": words, "generic": GENERIC})
    groups = dict(LITERATURE_ANCHORS[kind])
    several = kind == MULTI_AGENT and any_in(low, SEVERAL_AGENTS)
    if kind == MULTI_AGENT:
        groups["core"] = groups["core_several" if several else "core_single"]
    return Topic(topic, name, kind, several, groups)


def patent_topic(topic: str) -> Topic:
    low = topic.strip().lower()
    kind = next((k for k, parts in PATENT_TRIGGERS if any_in(low, parts)), GENERAL)
    if kind == GENERAL:
        words = tuple(topic_words(low))
        return Topic(topic, topic, kind, False, {"domain": words[:4]})
    return Topic(topic, topic, kind, kind == MULTI_AGENT and any_in(low, SEVERAL_AGENTS_PATENT), dict(PATENT_ANCHORS[kind]))


def distinct_strings(strings: list[str], most: int) -> list[str]:
    """Without regard to case distinct, in order, blanks left out, at most ``most``."""
    seen: dict[str, str] = {}
    for s in strings:
        if s.strip():
            seen.setdefault(s.strip().lower(), s.strip())
    return list(seen.values())[:most]


def searches(topic: str, side: str = "literature", most: int = 10) -> list[str]:
    """Search strings of a topic for literature or patents: the topic and those of its kind."""
    t = literature_topic(topic)
    known = (LITERATURE_SEARCHES if side == "literature" else PATENT_SEARCHES).get(t.kind)
    if known is None:
        phrase = " ".join(t["domain"][:3])
        known = tuple(f"{phrase} {s}" for s in GENERAL_SUFFIXES[side]) if len(t["domain"]) >= 2 else ()
    return distinct_strings([t.normalised, *known], most)


def expansions(topic: str, most: int = 8) -> list[str]:
    """Search strings of the live patent search: topic, synonyms of its field, structural forms."""
    raw, low = topic.strip(), topic.strip().lower()
    words = topic_words(low, 2)
    out = [raw, *next((s for parts, s in EXPANSIONS if any_in(low, parts)), ())]
    if len(words) >= 2:
        phrase = " ".join(words[:4])
        out += [f"{phrase} system", f"{phrase} method", f"{phrase} apparatus"]
        if len(words) >= 3:
            out += [" ".join(words[:3]), f"{words[-2]} {words[-1]} system"]
    got = distinct_strings(out, 12)
    if len(got) < 5 and words:
        core = " ".join(words[:3])
        got = distinct_strings([*got, *(f"{core} {s}" for s in ("process", "technology", "device", "analysis"))], 12)
    return got[:most]


# ---- the same for a column of topics


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(p).replace(r"\ ", " ").replace(r"\-", "-") for p in parts))


def corrected(topic: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(topic, F.lit(""))))
    for wrong, right in SPELLING:
        low = F.regexp_replace(low, rf"\b{wrong}\b", right)
    return F.regexp_replace(low, r"\bintelligence\s+artificial\b", "artificial intelligence")


def normalised(topic: Column) -> Column:
    """:func:`normalise_topic` of a column; '' for null."""
    low = corrected(topic)
    names = [(reduce(lambda a, b: a & b, [contains_any(low, p) for p in parts]), name) for parts, name in canonical_names()]
    out = F.when(names[0][0], names[0][1])
    for cond, name in names[1:]:
        out = out.when(cond, name)
    return out.otherwise(F.trim(F.coalesce(topic, F.lit(""))))


def topic_kind(normal: Column) -> Column:
    low = F.lower(normal)
    out = None
    for kind, parts in LITERATURE_TRIGGERS:
        cond = contains_any(low, parts)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise(GENERAL)


def search_strings(normal: Column, kind: Column, side: str = "literature", most: int = 10) -> Column:
    """Array of :func:`searches` for a column of normalised topics."""
    low = F.regexp_replace(F.lower(normal), r"[^a-zA-Z0-9\s\-]", " ")
    words = F.slice(F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*TOPIC_STOPS)), 1, 4)
    phrase = F.array_join(F.slice(words, 1, 3), " ")
    general = F.when(F.size(words) >= 2, F.array(*[F.concat_ws(" ", phrase, F.lit(s)) for s in GENERAL_SUFFIXES[side]])).otherwise(F.array().cast("array<string>"))
    table = LITERATURE_SEARCHES if side == "literature" else PATENT_SEARCHES
    known = None
    for k, strings in table.items():
        a = F.array(*[F.lit(s) for s in strings])
        known = F.when(kind == k, a) if known is None else known.when(kind == k, a)
    rest = F.filter(known.otherwise(general), lambda s: F.lower(s) != F.lower(normal))
    return F.slice(F.concat(F.filter(F.array(normal), lambda s: s != ""), rest), 1, most)
