"""Trigger families: phrases that mark a moment as worth a frame or a note.

The families, their phrases and confidences are fixed values of the task; a family matches a segment at most once, so
each is compiled to one alternation.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Family:
    """One trigger family: what it reads (raw or merged segments) and how it reports."""

    name: str
    trigger: str
    confidence: float
    content: str  # the content type it speaks for; "" for those that speak for none
    merged: bool
    context: int  # characters of context
    lower_context: bool
    phrases: tuple[str, ...]

    @property
    def pattern(self) -> str:
        return "|".join(f"(?:{p})" for p in self.phrases)


# Phrases of each family.
VISUAL = (
    r"\b(as you can see|look at|looking at)\b",
    r"\b(this (shows?|displays?|demonstrates?))\b",
    r"\b(here we (have|see))\b",
    r"\b(on the? (screen|slide|chart|graph|diagram))\b",
    r"\b(this (image|picture|photo|screenshot))\b",
    r"\b(let me show you)\b",
    r"\b(take a look)\b",
    r"\b(you\'ll notice)\b",
    r"\b(pointing (to|at))\b",
    r"\b(the (code|text) (here|above|below))\b",
)
TRANSITION = (
    r"\b(now let\'s (talk|move|look) (about|on|at))\b",
    r"\b(moving on to)\b",
    r"\b(the next (thing|topic|point))\b",
    r"\b(another (important|key))\b",
    r"\b(first|second|third|finally)\b",
    r"\b(in conclusion|to summarize|wrapping up)\b",
    r"\b(let\'s (start|begin) (with|by))\b",
)
PODCAST_TOPIC = (
    r"\b(so (tell me|what|how)|can you tell me)\b",
    r"\b(that\'s (interesting|fascinating|great|amazing))\b",
    r"\b(speaking of|talking about)\b",
    r"\b(i (have to|want to|need to) ask)\b",
    r"\b(let\'s (talk|go back|dive))\b",
    r"\b(what (was|is) (your|the))\b",
    r"\b(how did (you|that|it))\b",
    r"\b(i guess|so i guess)\b",
    r"\b(from your (point of view|perspective|experience))\b",
)
PODCAST_INSIGHT = (
    r"\b(the (key|main|important) (thing|point|takeaway))\b",
    r"\b(i (think|feel|believe) (that |the )?(most|really))\b",
    r"\b(what i\'ve (learned|found|realized))\b",
    r"\b(the truth is|honestly|to be honest)\b",
    r"\b(i would (say|tell|advise))\b",
    r"\b(my advice|one piece of advice)\b",
    r"\b((super|really|very) (important|inspiring|interesting))\b",
    r"\b(that\'s (exactly|precisely)|exactly right)\b",
)
PODCAST_EMPHASIS = (
    r"\b(it (genuinely|literally|actually|really) (is|was|changed))\b",
    r"\b(i\'m not (going to|gonna) lie)\b",
    r"\b(do you know what i mean)\b",
    r"\b(like (genuinely|seriously|honestly))\b",
    r"\b(it\'s (hard|difficult|challenging|intense))\b",
    r"\b(it was (incredible|amazing|life-?changing))\b",
    r"\b(i (love|loved) (that|this|it))\b",
)
SPEAKER_TURN = (
    r"\b(yeah|yes)[,.]?\s*(so|and|but|i)\b",
    r"\b(okay|ok)[,.]?\s*(so|and|i)\b",
    r"\b(right)[,.]?\s*(so|and|exactly)\b",
    r"\b(absolutely|definitely|exactly)\b",
    r"^(so|and|but|yeah)\s",
)
LECTURE_DEFINITION = (
    r"\b(is (defined as|the state of|when))\b",
    r"\b(refers to|means that)\b",
    r"\bwhat is [\w\s]+\?\s*\w+ is\b",
    r"\b(this is (called|known as|the))\b",
    r"\b(we (call|define|refer to) this)\b",
)
LECTURE_STRUCTURE = (
    r"\b(the (first|second|third|next|final) (layer|section|part|point))\b",
    r"\b(we\'ll (explain|explore|cover|discuss))\b",
    r"\b(let\'s (begin|start|move on) (with|to))\b",
    r"\b(this (leads|brings) us to)\b",
    r"\b(the (question|problem|issue) of)\b",
    r"\b(in (summary|conclusion|other words))\b",
)
LECTURE_CONCEPT = (
    r"\b(this (means|implies|suggests) that)\b",
    r"\b(the (key|central|fundamental) (idea|concept|point))\b",
    r"\b(in (philosophy|science|psychology))\b",
    r"\b(according to|as [\w\s]+ (argues|suggests|claims))\b",
    r"\b(the (relationship|connection) between)\b",
)
TUTORIAL_DEFINITION = (
    r"\b(a (high-?level|low-?level|compiled|interpreted))\b",
    r"\b(is (commonly|often|typically) used (to|for))\b",
    r"\b(allows you to|enables you to|lets you)\b",
    r"\b((programming|scripting) language)\b",
    r"\b(framework[s]? (like|such as))\b",
)
TUTORIAL_CODE = (
    r"\b(create a|define a|declare a)\b",
    r"\b(by (setting|using|adding|calling))\b",
    r"\b(instead of|rather than)\b",
    r"\b(uses? (indentation|semicolons|brackets|syntax))\b",
    r"\b(the (output|result|return value) (is|will be))\b",
    r"\b(run (this|the|your))\b",
)
TUTORIAL_FEATURE = (
    r"\b(it (also|additionally) (has|supports|includes|provides))\b",
    r"\b((also|additionally) (has|supports|comes with|provides))\b",
    r"\b(frameworks? (like|such as))\b",
    r"\b(libraries? (like|such as))\b",
    r"\b(tools? (like|such as))\b",
    r"\b(with (features|tools|libraries|packages) like)\b",
    r"\b(a huge (ecosystem|library|collection) of)\b",
    r"\b((built-?in|standard) (library|support|features))\b",
)

FAMILIES = (
    Family("visual", "visual_reference", 0.8, "", False, 100, False, VISUAL),
    Family("transition", "topic_transition", 0.7, "", False, 100, False, TRANSITION),
    Family("podcast_topic", "podcast_topic", 0.7, "podcast", True, 80, True, PODCAST_TOPIC),
    Family("podcast_insight", "podcast_insight", 0.85, "podcast", True, 80, True, PODCAST_INSIGHT),
    Family("podcast_emphasis", "podcast_emphasis", 0.75, "podcast", True, 80, True, PODCAST_EMPHASIS),
    Family("lecture_definition", "lecture_definition", 0.85, "lecture", True, 80, False, LECTURE_DEFINITION),
    Family("lecture_structure", "lecture_structure", 0.8, "lecture", True, 80, False, LECTURE_STRUCTURE),
    Family("lecture_concept", "lecture_concept", 0.75, "lecture", True, 80, False, LECTURE_CONCEPT),
    Family("tutorial_definition", "tutorial_definition", 0.85, "tutorial", True, 80, False, TUTORIAL_DEFINITION),
    Family("tutorial_code", "tutorial_code", 0.9, "tutorial", True, 80, False, TUTORIAL_CODE),
    Family("tutorial_feature", "tutorial_feature", 0.7, "tutorial", True, 80, False, TUTORIAL_FEATURE),
    Family("speaker_turn", "speaker_turn", 0.5, "turns", False, 80, False, SPEAKER_TURN),
)
BY_NAME = {f.name: f for f in FAMILIES}
#: Order in which content types win ties.
CONTENT_TYPES = ("podcast", "lecture", "tutorial")
#: Labels of mentions that count as entities (fixed values).
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "LOC", "WORK_OF_ART", "EVENT", "PRODUCT", "LAW", "NORP")
#: Terms that a topic stands for where the graph knows none (fixed values).
TOPIC_TERMS = {
    "consciousness": ("consciousness", "aware", "mind", "perception", "qualia", "experience"),
    "free will": ("free will", "determinism", "choice", "agency", "volition"),
    "meditation": ("meditation", "mindfulness", "breathing", "practice", "awareness"),
    "yoga": ("yoga", "pose", "breath", "stretch", "body", "movement"),
    "brain": ("brain", "neuroscience", "neural", "cortex", "neurons"),
    "stress": ("stress", "anxiety", "cortisol", "pressure", "tension"),
    "python": ("python", "programming", "code", "function", "variable"),
}
#: Words that label no topic (fixed values, in their usual order).
STOPWORDS = frozenset(
    """the a an and or but in on at to for of with by from as is was are were been be have has had do does did will
    would could should may might must shall can need that this these those it its it's i you he she we they them their
    his her my your our what which who whom when where why how all each every both few more most other some such no not
    only own same so than too very just also now here there then once if because about into through during before after
    above below up down out off over under again further while i'm you're we're they're i've you've we've don't doesn't
    didn't won't wouldn't couldn't shouldn't can't like know think going want say said get got make made see look come
    came way thing things something anything nothing everything really actually basically literally okay right well
    yeah yes oh um uh kind sort""".split()
)
