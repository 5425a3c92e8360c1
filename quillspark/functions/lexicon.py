"""Word lists and cue patterns. Patterns are written in the dialect of functions.patterns, which compiles them.

The lists of everyday and of academic words are parameters (see Lexicon): the defaults below are short lists of our own, and
a user with longer lists passes those.
"""

from __future__ import annotations

from dataclasses import dataclass

# Lists, cues and formats that results depend on.
BASIC_VERBS = "shows show showed showing says say said tells tell told explains explain explained means mean meant uses used use makes make made gives give describes describe talks talk proves prove".split()
ADVANCED_VERBS = (
    "interrogates interrogate interrogating foregrounds foreground foregrounding complicates complicate complicating juxtaposes juxtapose juxtaposing "
    "illuminates illuminate illuminating underscores underscore underscoring epitomizes epitomises epitomize exemplifies exemplify subverts subvert "
    "subverting destabilizes destabilises destabilize problematizes problematize critiques critique evokes evoke evoking conveys convey conveying "
    "highlights highlight highlighting emphasizes emphasises emphasize emphasizing reinforces reinforce reinforcing encapsulates encapsulate signifies "
    "signify connotes connote elucidates elucidate articulates articulate delineates delineate interrogated foregrounded complicated juxtaposed "
    "illuminated underscored exemplified subverted conveyed highlighted emphasized reinforced embodies embody embodying accentuates accentuate "
    "galvanizes situates situate positions reframes reframe undermines undermine"
).split()
HEDGES = "perhaps possibly potentially arguably seemingly somewhat likely presumably apparently maybe might may could suggests suggest suggesting appears appear seems seem partly partially relatively".split()
BOOSTERS = "clearly obviously definitely certainly undoubtedly surely always never must indeed truly absolutely evidently undeniably".split()
INTENSIFIERS = "very really extremely so highly incredibly deeply profoundly truly totally completely utterly particularly especially remarkably exceptionally".split()
MODALS = "can could may might must shall should will would".split()
EVALUATIVE = "important interesting powerful effective good bad great significant crucial vital essential meaningful striking compelling poignant sad happy strong weak".split()
FIRST_PERSON = "i me my mine myself".split()
SUBORDINATORS = "because although though while whereas since unless until whenever wherever whether if as after before once".split()
RELATIVES = "which who whom whose that where when".split()
DETERMINERS = "this that these those the a an".split()
PREPOSITIONS = "of in to for with on at by from about into through over after between under against during without within among throughout toward towards upon across beyond despite".split()
LY_NOT_ADVERBS = "family only early likely lonely friendly ugly holy silly supply apply reply rely fly july italy daily ally belly bully".split()
TRANSITIONS = [
    "furthermore", "moreover", "additionally", "ultimately", "in conclusion", "similarly", "consequently", "nevertheless", "nonetheless", "in addition",
    "thus", "hence", "therefore", "however", "in contrast", "conversely", "overall", "in summary", "to conclude", "notably", "also", "another", "first",
    "firstly", "secondly", "finally", "for example", "for instance", "on the other hand", "as a result", "in other words", "meanwhile", "likewise",
]
MISSPELLINGS = "alot becuase beacuse definately recieve seperate untill wich thier beleive occured begining realy finaly truely arguement goverment enviroment wierd tommorow basicly noone everytime infront thru gonna wanna kinda dont doesnt didnt cant wont isnt im ive thats".split()
STOP_CONTENT = "this that with from have they their there which when what also into about shows because these those were been them then than more some".split()
STEM_SUFFIXES = "ically ingly ations ation ness ments ment ities ity ing ies ied ed ly es s".split()
ABBREVIATIONS = "Mr Mrs Ms Dr St vs etc e\\.g i\\.e p pp ch Vol No".split()

WORD = r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-z]+)*"
QUOTE = r"\"[^\"\n]{1,600}\"|“[^”\n]{1,600}”"
NOMINAL = r"\b[a-z]{3,}(?:tion|sion|ment|ness|ity|ance|ence|ism)s?\b"
ABSTRACT = r"\b(?:ideolog\w*|epistemolog\w*|hegemon\w*|power|authority|institution\w*|identity|identities|society|societal|humanity|human nature|human condition|morality|moral|civili[sz]ation|order|chaos|freedom|justice|truth|reality|existence|construct\w*|instabilit\w*|agency|subjectivit\w*|discourse|paradigm|dialectic\w*|liminal\w*|duality|dichotom\w*|paradox\w*|tension|fragility|nature of|essence|condition|structures?|systems?|value systems?|collective|individualism)\b"
EVIDENCE_TYPES = {
    "imagery": r"\b(?:imagery|image|images|visual(?:ly)?|describes? the|colou?rs?|light|darkness)\b",
    "symbolism": r"\b(?:symbol(?:s|ic|ism|izes|ises|ize)?|represents?|stands? for|signif(?:y|ies))\b",
    "characterization": r"\b(?:character(?:ization|isation|s)?|personality|motivations?|protagonist|antagonist)\b",
    "perspective": r"\b(?:narrator|narrative (?:voice|perspective)|point of view|first[- ]person|third[- ]person|perspective|focaliz\w*)\b",
    "structure": r"\b(?:structure|structural|chapter|opening|ending|climax|foreshadow\w*|flashback|pacing|cyclical)\b",
    "visual": r"\b(?:composition|framing|foreground|background|layout|camera|shot|panel|typography)\b",
    "diction": r"\b(?:diction|word choice|the word|the verb|the adjective|connotations?|lexis|language)\b",
    "syntax": r"\b(?:syntax|sentence (?:structure|length)|fragment|repetition|anaphora|parallelism|list)\b",
    "juxtaposition": r"\b(?:juxtapos\w*|contrast(?:s|ed|ing)?|opposition|binary)\b",
    "motif": r"\b(?:motifs?|recurring|recurs|repeated(?:ly)?)\b",
    "context": r"\b(?:historical|context|written in|published|at the time|era|century|society of the time|biograph\w*)\b",
}
#: (id, pattern, whether case counts)
SURFACE = [
    ("genericTransitions", r"(?:^|[.!?]\s+)(?:Furthermore|Moreover|Additionally|In addition|Ultimately|Consequently|Notably|In essence),", True),
    ("notOnlyButAlso", r"\bnot only\b[^.]{1,90}?\bbut(?: also)?\b", False),
    ("importantToNote", r"\bit is (?:important|worth|crucial|essential|vital) to (?:note|recognize|recognise|consider|acknowledge|understand)\b|\bit is worth noting\b", False),
    ("genericConclusion", r"\bserves? as a (?:powerful |stark |poignant )?reminder\b|\btimeless\b|\bthe human (?:experience|condition)\b|\bremains relevant (?:today|to)\b", False),
    ("repetitiveQualification", r"(?:^|[.!?]\s+)(?:While|Although)\b[^.]{5,}?,\s*[^.]*\bultimately\b", True),
    ("signposting", r"\bthis essay will\b|\bthis allows the reader\b|\bthe reader can (?:therefore )?see\b", False),
]
#: Cues of what a sentence does; case counts in evidenceLead only.
CUES = {
    "thesis": r"\b(?:I (?:will )?argue|this essay (?:will )?(?:argue|explore|show|discuss|examine)|in this essay|I will (?:talk|discuss|explain|show))\b",
    "counterpoint": r"\b(?:some (?:readers |critics )?(?:might|may|could|would) (?:argue|suggest|say|read)|on the other hand|critics|one could argue|it could be argued|alternatively|a different reading|another reading|others (?:might|may) (?:argue|suggest|read)|admittedly|at first glance)\b",
    "citation": r"\(\s*(?:p\.?\s*|pp\.?\s*|ch\.?\s*|chapter\s+)?\d+(?:[.:\-–]\d+)*\s*\)",
    "evidenceLead": r"\b(?:for example|for instance|in chapter \d+|according to|the (?:text|novel|poem|author|narrator) (?:states|says|describes)|is described as|when [A-Z][a-z]+ (?:says|tells|first|sees|finds|holds|blows))\b",
    "qualification": r"\b(?:although|though|whereas|to some extent|in part|partly|not entirely|not simply|not merely|arguably|perhaps|complicat\w*|ambigu\w*|however|nevertheless|while (?:it|this|the|he|she|they)\b[^,]*,)",
    "implication": r"\b(?:ultimately|more broadly|beyond the|universal\w*|human (?:nature|condition|experience|heart)|humanity|society|societies|the novel as a whole|wider|broader implications?|what it means to|our own world|today)\b",
    "context": r"\b(?:written (?:in|after|during)|published|at the time|historical(?:ly)?|historic|context|post-war|during the|century|era|world war|cold war|biograph\w*)\b|\b(?:1[5-9]\d\d|20[0-2]\d)s?\b",
    "reasoning": r"\b(?:therefore|thus|because|since|as a result|consequently|which means|this means|so that|hence|which is why|that is why)\b",
    "explanation": r"\b(?:this|these|that|which|it|such|here)\s+(?:\w+\s+){0,2}?(?:shows?|suggests?|reveals?|means?|demonstrates?|highlights?|implies?|represents?|symboli[sz]es|conveys?|emphasi[sz]es|illustrates?|indicates?|underscores?|foregrounds?|interrogates?|exposes?|complicates?|reflects?|signals?)\b|\b(?:represents|symboli[sz]es|shows that|suggests that|reveals that|means that|in other words)\b",
    "analytic": r"\b(?:shows?|suggests?|reveals?|means?|demonstrates?|highlights?|implies?|represents?|symboli[sz]es|conveys?|emphasi[sz]es|illustrates?|indicates?|underscores?|foregrounds?|interrogates?|exposes?|complicates?|reflects?|because|evokes?|juxtapos\w*|critiques?)\b",
}
OPENS_BY_INTERPRETING = r"^(?:This|These|That|Which|Such|It|Here)\b"
REPORTING = r"\b(?:says?|said|states?|stated|writes?|wrote|tells?|told|explains?|claims?|remarks?|notes?|argues?)\b[^a-z]{0,4}$"
PASSIVE = r"\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b"
QUALIFIED = r"\b(?:although|though|however|while|whereas|to some extent|in part|partly|not entirely|it could be argued|may|might|perhaps)\b"
CONTRACTION = r"\b\w+['’](?:t|s|re|ve|ll|d|m)\b"

#: Our own short defaults of the two lists that are parameters.
EVERYDAY = (
    "a about above across after again all almost along already also although always among and another answer any anyone anything are around ask at away "
    "back became because become been before began begin being believe below best better between both bring brother build but by call came can child children "
    "city clear close come could country day did different does done down during each early earth either else end enough even evening ever every everyone "
    "everything example eye face family far father feel few find first follow food for friend from full further future general get give go good great group "
    "grow had half hand happen has have he head hear help her here himself home house however hundred idea important into itself just keep kind know large "
    "last later learn least leave less let letter life light like little live long look made make many maybe me mean measure might minute moment money more "
    "morning most mother mountain move much must name nature never next night nothing "
    "notice number object often once only open other our out outside over own paper parent part party pass past people perhaps person picture piece place plan "
    "plant play point poor possible power practice present pretty probably problem produce provide public question quickly quiet quite rather reach read ready "
    "real really reason receive remember rest result return right river road room round rule run said same school science season second secret seem sentence "
    "several shall short should show side simple since sister sit small social some somebody someone something sometimes somewhere soon sound speak special "
    "stand start state stay still stop story strange street strong student study such suddenly summer sure surprise system table take teacher tell than that "
    "their themselves then there therefore these they thing think third this those though thought thousand three through throughout time today together tomorrow "
    "tonight toward towards town travel tree trouble true trust try turn under understand until upon use useful usually very village visit voice wait walk want "
    "warm watch water weather week welcome well were what whatever when whenever where whether which while white whole whose winter with within without woman "
    "wonder wonderful word work world worry would write wrong yard year yellow yes yesterday yet you young your yourself zero"
).split()
ACADEMIC = (
    "abstract academic accurate acquire adapt adequate adjust allocate alter analyse analysis analyze approach arbitrary aspect assess assume authority "
    "bias bulk capacity category causal clarify coherent coincide complex component compose comprise concept conclude conduct confirm consequence consist "
    "constrain construct context contradict contrast convention convert core correlate crucial culture data deduce define demonstrate derive devise dimension "
    "discourse distinct diverse dynamic element emerge emphasis empirical enable entity equate establish estimate evaluate evidence evolve explicit exploit "
    "facilitate factor finite focus formulate framework function fundamental generate hierarchy hypothesis identify ideology illustrate impact implement "
    "implicit imply impose index infer inherent innovate insight institution integral interpret intervene intrinsic invoke isolate layer logic mechanism "
    "mediate method minimal modify motive narrative norm notion obtain orient paradigm parameter perceive perspective phase phenomenon policy "
    "portion posit precede precise predominant premise presume principle prior process prohibit proportion psychology publish pursue qualitative quantify radical "
    "random range ratio rational react refine regime region regulate reinforce reject relevant rely require research resolve respond restrict reveal revise role "
    "scenario scheme scope section sector secure seek select sequence series shift significant similar simulate sociology sole source specific specify stable "
    "statistic status stimulate strategy stress structure subordinate subsequent substitute sufficient sum summarize supplement survey sustain symbol synthesis "
    "tension terminate text theme theory thereby thesis trace tradition transform transition transmit trend trigger ultimate undergo underlie undertake uniform "
    "unify unique utilize valid variable vary verify version via violate virtual visible vision vital volume voluntary whereas whereby widespread yield"
).split()


@dataclass(frozen=True)
class Lexicon:
    """The two long lists: everyday words, outside of which a long word counts as less common, and academic words."""

    everyday: tuple[str, ...] = tuple(EVERYDAY)
    academic: tuple[str, ...] = tuple(ACADEMIC)

    @staticmethod
    def from_table(rows) -> Lexicon:
        """From rows (list, term) with list everyday or academic, as a lexicon table holds them."""
        found: dict[str, list[str]] = {"everyday": [], "academic": []}
        for name, term in rows:
            found[name].append(term)
        return Lexicon(tuple(found["everyday"]), tuple(found["academic"]))
