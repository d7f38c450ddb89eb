"""Keyed HTML records to entries, postings and issues.

Records are parsed in Arrow batches, a record at a time. A page is walked once: every element is filed, by its class, with
the innermost unit (entry, phrasal verb, run-on, sense, subsense) that holds it; entries are then
read off the units. The classes that hold each field are a parameter (``Layout``), so that other
sources of the same shape need no code.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions.phrases import key_pair, loose_key, phrase_keys, squeeze
from quillspark.sources.html import Node, tree

#: Fixed value: how a redirect record begins.
LINK = "@@@LINK="

#: Boxes that belong to no entry; boxes that hold no senses; what a definition's text leaves out; where an entry's head ends.
DROPPED = ["at-link", "popup-button", "verbtable", "etymology", "etymbox", "thesbox", "usagebox", "grambox", "f2nbox", "popwf", "wf", "entrymenu", "pope_menu", "errorbox", "imgholder", "popexa", "popthes", "popcollo", "popetym", "popphrase"]
NO_SENSES = ["phrvbentry", "phrvbs", "runon", "collobox", "exponent", "example", "exas", "menuitem"]
ASIDE = ["example", "exas", "exaen", "colloinexa", "gramexa", "colloexa", "collo", "propform", "propformprep", "cllt", "cl"]
BODY = ["sense", "phrvbs", "phrvbentry", "runon", "tail", "spokensect", "collobox"]
#: Class of an inflected form and its type; class of a label and its type.
INFLECTIONS = {"pluralform": "plural", "pasttense": "past", "pastpart": "past_participle", "prespart": "present_participle", "t3perssing": "third_person", "superl": "superlative", "ptandpp": "past_and_past_participle"}
LABELS = {"registerlab": "register", "geo": "geo", "ac": "domain"}


_BODY, _ASIDE, _NO_SENSES = frozenset(BODY), frozenset(ASIDE), frozenset(NO_SENSES)


@dataclass(frozen=True)
class Layout:
    """Class names of a source's fields; several names are alternatives, the first that is there counts."""

    entry: str = "entry"
    phrasal: str = "phrvbentry"
    runon: str = "runon"
    sense: str = "sense"
    subsense: str = "subsense"
    headword: tuple[str, ...] = ("hwd", "hyphenation")
    phrasal_head: tuple[str, ...] = ("phrvbhwd", "entryhead")
    runon_head: str = "deriv"
    homograph: str = "homnum"
    pos: str = "pos"
    grammar: str = "gram"
    codes: str = "proncodes"
    pron: str = "pron"
    pron_us: tuple[str, ...] = ("amevarpron", "amepron")
    level: str = "level"
    frequency: str = "freq"
    number: str = "sensenum"
    signpost: str = "signpost"
    definition: str = "def"
    full_form: str = "fullform"
    lexunit: str = "lexunit"
    patterns: tuple[str, ...] = ("propform", "propformprep")
    lexvar: str = "lexvar"
    variant: str = "variant"
    collocation: str = "collocate"
    collocation_box: str = "collobox"
    collocation_text: tuple[str, ...] = ("colloc", "collo")
    collocation_gloss: str = "collgloss"
    references: tuple[str, ...] = ("refhwd", "reflex")
    reference_homograph: str = "refhomnum"
    reference_sense: str = "refsensenum"
    reference_mark: str = "crossref"
    tail: str = "tail"
    front_matter: str = "dict-faq"
    labels: dict[str, str] = field(default_factory=lambda: LABELS)
    inflections: dict[str, str] = field(default_factory=lambda: INFLECTIONS)
    dropped: frozenset[str] = frozenset(DROPPED)

    @cached_property
    def carried(self) -> frozenset[str]:
        """The classes that anything asks for further down; others are not carried along."""
        return _ASIDE | _NO_SENSES | {"group", "wswd", self.definition, self.tail, self.subsense, self.collocation_box, *self.pron_us}

    @cached_property
    def unread(self) -> frozenset[str]:
        """What the text of a gloss leaves out."""
        return _ASIDE | self.dropped

    @cached_property
    def no_gloss(self) -> frozenset[str]:
        """Where a definition is not that of the unit."""
        return _ASIDE | {self.collocation_box, self.subsense, "exponent"}

    @cached_property
    def traits(self) -> Callable[[frozenset[str]], tuple[bool, frozenset[str], bool]]:
        """Of the classes of an element: whether the head ends here, those carried along, whether it may open a unit."""
        opening = {self.entry, self.phrasal, self.runon, self.sense, self.subsense}
        return lru_cache(maxsize=4096)(lambda classes: (bool(classes & _BODY), classes & self.carried, bool(classes & opening)))


LAYOUT = Layout()
LABEL = "array<struct<type:string,value:string,scope:string>>"
PHRASE = f"array<struct<id:string,type:string,text:string,definition:struct<en:string,zh:string>,labels:{LABEL},sense_id:string,patterns:array<string>>>"
REFERENCE = "array<struct<text:string,href:string,homograph:int,sense:string,relation:string>>"
#: What of an entry is a column; the sense tree has no fixed depth and stays JSON text.
BODY_COLUMNS = ["headword", "display", "homograph", "pronunciations", "frequency", "inflections", "pos_groups", "phrases", "cross_refs", "parent", "notes"]
ENTRY = (
    "kind_no int, record_kind string, id string, kind string, headword string, display string, homograph int, pronunciations array<struct<ipa:string,accent:string,raw:string>>, "
    "frequency struct<stars:string,spoken:string,written:string>, inflections array<struct<type:string,form:string>>, pos_groups string, "
    f"phrases {PHRASE}, cross_refs {REFERENCE}, parent struct<id:string,headword:string,relation:string>, notes array<string>, "
    "postings array<struct<norm:string,sense_id:string,match:string,key_raw:string>>, issues array<string>"
)
POSTING = ("norm", "sense_id", "match", "key_raw")
#: Units of a page may hold one another this deep; a page with deeper ones is an issue, not an entry.
MOST_NESTED = 200
LEXICAL = re.compile("[A-Za-z0-9À-ɏ一-鿿]")
_json = json.JSONEncoder(ensure_ascii=False).encode
ABBREVIATION = re.compile(r"abbreviation\s+of\.?\Z", re.IGNORECASE)


@dataclass(eq=False, slots=True)
class Spot:
    """An element in its place: the unit it is filed with, and the classes between the two."""

    node: Node
    unit: Unit | None
    above: frozenset[str]
    anchor: str | None
    href: str | None
    siblings: list[Node]
    order: int = 0
    head: bool = False

    def around(self, unit: Unit) -> set[str]:
        """Classes of the elements between this one and a unit that holds it."""
        found, at = set(self.above), self.unit
        while at is not None and at is not unit and at.spot is not None:
            found |= at.spot.node.classes | at.spot.above
            at = at.spot.unit
        return found


@dataclass(eq=False, slots=True)
class Unit:
    role: str
    spot: Spot | None
    filed: dict[str, list[Spot]] = field(default_factory=lambda: defaultdict(list))
    units: list[Unit] = field(default_factory=list)
    headless: bool = False  # whether the head has ended
    holders: tuple[Unit, ...] = ()  # the unit and all that hold it, from within
    held: frozenset[str] = frozenset()  # their roles
    entry: Unit | None = None  # the innermost of them that is an entry, a phrasal verb or a run-on
    names: set[str] = field(default_factory=set)  # all classes of the page

    def __post_init__(self) -> None:
        above = self.spot.unit if self.spot is not None else None
        self.holders = (self, *(above.holders if above is not None else ()))
        self.held = (above.held if above is not None else frozenset()) | {self.role}
        self.entry = self if self.role in ("entry", "phrasal", "runon") else above.entry if above is not None else None
        self.names = above.names if above is not None else self.names

    def within(self) -> Iterator[Unit]:
        todo = [self]
        while todo:
            unit = todo.pop()
            yield unit
            todo.extend(reversed(unit.units))

    def every(self, name: str, *roles: str) -> list[Spot]:
        """Spots of a class here and in the units below, or those below of the given roles, in order."""
        if name not in self.names:
            return []
        if not self.units:
            return self.filed.get(name, [])
        found = [s for u in self.within() if u is self or not roles or u.role in roles for s in u.filed.get(name, ())]
        return sorted(found, key=lambda s: s.order)

    def heads(self, *names: str) -> list[Spot]:
        found = [s for n in names if n in self.names for s in self.filed.get(n, ()) if s.head]
        return sorted(found, key=lambda s: s.order) if len(found) > 1 else found


def leading(node: Node) -> Node | None:
    """The first element in an element."""
    for child in node.children:
        if isinstance(child, Node):
            return child
    return None


def anchor_name(node: Node | None) -> str | None:
    return (node.attrs.get("id") or node.attrs.get("name")) if node is not None and node.tag == "a" else None


def once(items: Iterable) -> list:
    return list(dict.fromkeys(x for x in items if x))


class Record:
    """The parse of one record."""

    def __init__(self, key: str, html: str, layout: Layout = LAYOUT):
        self.key, self.at, self.issues = key, layout, []
        self.traits = layout.traits
        self.root = tree(html)
        self.page = Unit("page", None)
        self.classes = self.page.names
        self.too_deep = False
        self._walk()

    # -- one walk -----------------------------------------------------------------------
    def _walk(self) -> None:
        dropped = self.at.dropped
        todo = [Spot(self.root, self.page, frozenset(), None, None, [])]
        order = 0
        while todo:
            spot = todo.pop()
            node, inner, above = spot.node, spot.unit, spot.above
            if node is not self.root:
                order += 1
                if node.classes:
                    spot.order = order
                    self.classes |= node.classes
                    inner, above = self._file(spot, node.classes)
            below = [c for c in node.children if isinstance(c, Node) and not c.classes & dropped]
            if not below:
                continue
            href = (node.attrs.get("href") if node.tag == "a" else None) or spot.href
            # an anchor names the next element with a class; bare elements between them do not count
            named, placed = None, []
            for child in below:
                placed.append(Spot(child, inner, above, named or anchor_name(leading(child)), href, below))
                if child.tag == "a":
                    named = anchor_name(child) or named
                elif child.classes:
                    named = None
            placed.reverse()
            todo += placed

    def _file(self, spot: Spot, classes: frozenset[str]) -> tuple[Unit, frozenset[str]]:
        unit = spot.unit
        entry = unit.entry
        body, carried, opens = self.traits(classes)
        if entry is not None:
            if body:
                for holder in unit.holders:
                    holder.headless = True
            spot.head = not unit.headless
        for name in classes:
            unit.filed[name].append(spot)
        role = self._role(classes, spot, unit.held, entry) if opens else None
        self.too_deep |= role is not None and len(unit.holders) > MOST_NESTED
        if role is None or self.too_deep:
            return unit, spot.above if carried <= spot.above else spot.above | carried
        opened = Unit(role, spot)
        unit.units.append(opened)
        return opened, frozenset()

    def _role(self, classes: frozenset[str], spot: Spot, held: frozenset[str], entry: Unit | None) -> str | None:
        if entry is None:
            return "entry" if self.at.entry in classes else None
        if self.at.phrasal in classes and "phrasal" not in held:
            return "phrasal"
        if self.at.runon in classes and "runon" not in held:
            return "runon"
        if spot.above & _NO_SENSES:
            return None
        if self.at.sense in classes and spot.unit.role in ("entry", "phrasal"):
            return "sense"
        return "subsense" if self.at.subsense in classes and spot.unit.role in ("sense", "subsense") else None

    def release(self) -> None:
        """Takes the cycles of spots and units apart, so that what a page held goes at once and not by the garbage collector."""
        for unit in list(self.page.within()):
            unit.filed, unit.units, unit.holders, unit.entry = {}, [], (), None

    # -- fields ---------------------------------------------------------------------------
    def pair(self, node: Node, english: tuple[str, ...], chinese: tuple[str, ...]) -> dict:
        """The first text of either language; its elements are named by tags."""
        skip = self.at.unread
        first = lambda tags: next((t for n in node.walk() if n.tag in tags and not n.classes & skip and (t := n.text(skip))), None)
        return {"en": first(english), "zh": first(chinese)}

    def definition(self, unit: Unit) -> dict:
        """The first gloss that holds letters, with the full forms printed beside it; a shell of collocations is none."""
        blocked = self.at.no_gloss
        found = {"en": None, "zh": None}
        for spot in unit.filed.get(self.at.definition, ()):
            if spot.above & blocked:
                continue
            pair = {k: v if v and LEXICAL.search(v) else None for k, v in self.pair(spot.node, ("en",), ("tran",)).items()}
            if not any(pair.values()):
                plain = spot.node.text(self.at.unread)
                pair["en"] = plain if LEXICAL.search(plain) else None
            if any(pair.values()):
                found = pair
                break
        return found

    def with_full_forms(self, unit: Unit, english: str | None) -> str | None:
        if self.at.full_form not in unit.filed:
            return english or None
        forms = once(s.node.text() for s in unit.filed.get(self.at.full_form, ()) if self.at.definition not in s.above)
        missing = " / ".join(f for f in forms if LEXICAL.search(f) and f.casefold() not in (english or "").casefold())
        if not missing or not english:
            return english or missing or None
        return f"{english.rstrip('.')} {missing}" if ABBREVIATION.search(english) else f"{english} ({missing})"

    def labels(self, spots: Iterable[Spot], scope: str) -> list[dict]:
        found = once((next(kind for name, kind in self.at.labels.items() if name in s.node.classes), s.node.text()) for s in spots)
        return [{"type": kind, "value": value, "scope": scope} for kind, value in found if value]

    def labels_in(self, unit: Unit, scope: str) -> list[dict]:
        if self.classes.isdisjoint(self.at.labels):
            return []
        blocked = _ASIDE | {self.at.collocation_box, self.at.phrasal, self.at.runon}
        spots = (s for name in self.at.labels for s in unit.every(name, "subsense") if not s.around(unit) & blocked)
        return self.labels(spots, scope)

    def grammar(self, spots: Iterable[Spot]) -> list[str]:
        return [g for s in spots for part in re.split("[,;]", s.node.text().strip("[]")) if (g := part.strip("[] "))]

    def pos(self, spots: Iterable[Spot]) -> list[str]:
        return [p for s in spots for part in re.split("[,/，]", s.node.text()) if (p := part.strip(" .;"))]

    def references(self, unit: Unit, inside: str | None = None) -> list[dict]:
        """Cross references of a unit and all below it, with homograph and sense where they stand beside the word."""
        found = {}
        for name in self.at.references:
            for spot in unit.every(name):
                around = spot.around(unit)
                if around & _ASIDE or inside is not None and inside not in around:
                    continue
                text = spot.node.text()
                text = text[3:].strip() if text.casefold().startswith("at ") else text
                digits = re.sub(r"\D", "", self.beside(spot, self.at.reference_homograph) or "")
                sense = (self.beside(spot, self.at.reference_sense) or "").strip("()").strip()
                number = int(digits[:9]) if digits else 0
                if text:
                    row = text, (spot.node.attrs.get("href") if spot.node.tag == "a" else None) or spot.href, number or None, sense or None
                    found.setdefault(row, dict(zip(("text", "href", "homograph", "sense", "relation"), (*row, "see"), strict=True)))
        return list(found.values())

    def beside(self, spot: Spot, name: str) -> str | None:
        """Text of a sibling: the first that follows, else the first of all."""
        place = next(i for i, n in enumerate(spot.siblings) if n is spot.node)
        near = (n for n in (*spot.siblings[place + 1 :], *spot.siblings) if name in n.classes)
        node = next(near, None)
        return None if node is None else node.text()

    def coded(self, codes: Node) -> list[tuple[str, str, str]]:
        """(ipa, accent, raw) of a block of codes: the first British and the first American one, else all of it, of no accent."""
        raw = codes.text()
        american = [n for n in codes.walk() if n.classes & set(self.at.pron_us)]
        under = {id(x) for n in american for x in n.walk()}
        british = [n for n in codes.walk() if self.at.pron in n.classes and id(n) not in under]
        out = [(nodes[0].text(), accent) for nodes, accent in ((british, "br"), (american, "us")) if nodes]
        out = [(ipa, accent, raw) for text, accent in out if (ipa := text.lstrip("$ ") if accent == "us" else text)]
        rest = squeeze(raw.replace("/", " ").replace("$", " "))
        return out or ([(rest, "unspecified", raw)] if rest else [])

    def pronunciations(self, spots: Iterable[Spot]) -> list[dict]:
        found = {}
        for spot in spots:
            if self.at.codes in spot.node.classes:
                rows = self.coded(spot.node)
            elif spot.node.classes & set(self.at.pron_us) or spot.above & set(self.at.pron_us):
                continue
            else:
                text = spot.node.text()
                rows = [(text, "br", text)] if text else []
            for ipa, accent, raw in rows:
                found.setdefault((ipa, accent), {"ipa": ipa, "accent": accent, "raw": raw})
        return list(found.values())

    # -- senses ---------------------------------------------------------------------------
    def sense(self, unit: Unit, id_: str, placed: list[tuple[Unit, dict]]) -> dict:
        """The sense of a unit; it and those below go to ``placed``, in order."""
        at, own = self.at, unit.filed.get
        number = next((s.node.text().strip(".") for s in own(at.number, ())), None)
        sense: dict = {"id": id_, "number": number or None, "signpost": None}
        placed.append((unit, sense))
        below = [self.sense(u, u.spot.anchor or f"{id_}.{i}", placed) for i, u in enumerate((u for u in unit.units if u.role == "subsense"), 1)]
        if post := next(iter(own(at.signpost, ())), None):
            pair = self.pair(post.node, ("en", "signen"), ("tran", "sign"))
            pair = pair if any(pair.values()) else {"en": post.node.text() or None, "zh": None}
            sense["signpost"] = pair if any(pair.values()) else None
        shown = {"example", "exas", "exaen", at.collocation_box}
        definition = self.definition(unit)
        definition["en"] = self.with_full_forms(unit, definition["en"])
        units = once(s.node.text() for s in own(at.lexunit, ()) if "menuitem" not in s.above)
        given = {"en": None, "zh": None} if below else definition
        sense |= {
            "grammar": self.grammar(own(at.grammar, ())), "labels": self.labels_in(unit, "sense"),
            "patterns": once(s.node.text() for name in at.patterns for s in unit.every(name, "subsense") if not s.around(unit) & shown),
            "lexunits": units, "definition": definition, "cross_refs": self.references(unit),
            "phrases": [{"id": f"{id_}#lu{j}", "type": "lexical_unit", "text": t, "definition": given, "labels": [], "sense_id": id_, "patterns": []} for j, t in enumerate(units, 1)],
            "senses": below,
        }
        return sense

    def senses(self, unit: Unit, id_: str) -> tuple[list[dict], list[tuple[Unit, dict]]]:
        placed: list[tuple[Unit, dict]] = []
        nodes = [u for u in unit.units if u.role == "sense"]
        return [self.sense(u, u.spot.anchor or f"{id_}#s{i}", placed) for i, u in enumerate(nodes, 1)], placed

    def attach_variants(self, placed: list[tuple[Unit, dict]]) -> None:
        """Printed variants become patterns of their sense: by its anchor, else by its number, else of the only sense."""
        if self.classes.isdisjoint((self.at.variant, self.at.lexvar)):
            return
        for unit, sense in placed:
            bare = (s.node for s in unit.every(self.at.variant, "subsense") if s.node.first(self.at.lexvar) is None)
            variants = [s.node.text() for s in unit.every(self.at.lexvar, "subsense")] + [t for n in bare if not (t := n.text()).casefold().startswith("also")]
            target = sense if unit.spot.anchor else next((s for _, s in placed if sense["number"] and s["number"] == sense["number"]), placed[0][1] if len(placed) == 1 else None)
            if target is not None:
                target["patterns"] = once([*target["patterns"], *variants])

    # -- entries --------------------------------------------------------------------------
    def collocations(self, unit: Unit, id_: str) -> list[dict]:
        out = []
        for i, spot in enumerate(unit.every(self.at.collocation), 1):
            node = spot.node
            text = (next((n for n in map(node.first, self.at.collocation_text) if n), None) or node).text()
            if text and self.at.collocation_box in spot.around(unit):
                gloss = node.first(self.at.collocation_gloss)
                meaning = {"en": gloss.text().strip("()= ") or None if gloss else None, "zh": None}
                out.append({"id": f"{id_}#col{i}", "type": "collocation", "text": text, "definition": meaning, "labels": [], "sense_id": None, "patterns": []})
        return out

    def main(self, unit: Unit) -> dict | None:
        at = self.at
        heads = [s.node.text() for name in at.headword for s in unit.every(name, "sense", "subsense")]
        headword = next((h for h in heads if h), None)
        if headword is None:
            self.issues.append("missing_headword")
            return None
        digits = next((d for s in unit.heads(at.homograph) if (d := re.sub(r"\D", "", s.node.text()))), None)
        homograph = int(digits[:9]) if digits else None
        id_ = unit.spot.anchor or f"key:{slug(headword)}:{homograph or 1}"
        refers = at.definition not in self.classes and at.reference_mark in self.classes
        senses, placed = self.senses(unit, id_)
        self.attach_variants(placed)
        levels = {"stars": None, "spoken": None, "written": None}
        for spot in unit.heads(at.level, at.frequency):
            text = spot.node.text()
            name = "stars" if at.level in spot.node.classes else {"S": "spoken", "W": "written"}.get(text[:1])
            if name and text:
                levels[name] = text
        pos = [s for s in unit.heads(at.pos) if not s.above & {"wswd", "wf", "group"}]
        group = {"pos": once(self.pos(pos)), "grammar": once(self.grammar(unit.heads(at.grammar))), "labels": self.labels(unit.heads(*at.labels), "pos"), "senses": senses}
        forms = [{"type": kind, "form": t} for s in unit.heads(*at.inflections) for name, kind in at.inflections.items() if name in s.node.classes and (t := s.node.text())]
        return {
            "id": id_, "kind": "see_also" if refers else "word", "headword": headword, "homograph": homograph, "pronunciations": self.pronunciations(unit.heads(at.codes, at.pron)),
            "frequency": levels if any(levels.values()) else None, "inflections": forms, "groups": [group], "phrases": self.collocations(unit, id_),
            "cross_refs": self.references(unit, None if refers else at.tail), "parent": None, "notes": ["no_standard_def; cross-reference entry"] if refers else [],
        }

    def phrasal(self, unit: Unit, parent: dict) -> dict | None:
        spot = next((s[0] for name in self.at.phrasal_head if (s := unit.every(name))), None)
        headword = squeeze(spot.node.text().replace("↔", " ↔ ")) if spot else ""
        id_ = unit.spot.anchor or f"{parent['id']}#pv:{slug(headword)}"
        group = {"pos": ["phrasal verb"], "grammar": once(self.grammar(unit.heads(self.at.grammar))), "labels": self.labels(unit.heads(*self.at.labels), "phrase"), "senses": self.senses(unit, id_)[0]}
        return self.child(id_, "phrasal_verb", "phrasal_verb", headword, unit, parent, [], group, []) if headword else None

    def runon(self, unit: Unit, parent: dict) -> dict | None:
        spot = next(iter(unit.filed.get(self.at.runon_head, ())), None)
        headword = re.sub(r"^[\s—–-]+", "", (spot or unit.spot).node.text())
        id_ = unit.spot.anchor or f"{parent['id']}#deriv:{slug(headword)}"
        definition = self.definition(unit)
        bare = {"number": None, "signpost": None, "grammar": [], "labels": [], "patterns": [], "lexunits": [], "cross_refs": [], "phrases": [], "senses": []}
        senses = [{"id": f"{id_}#s1", "definition": definition} | bare] if any(definition.values()) else []
        own = lambda name: unit.filed.get(name, ())
        group = {"pos": self.pos(own(self.at.pos)) or ["unknown"], "grammar": self.grammar(own(self.at.grammar)), "labels": self.labels_in(unit, "entry"), "senses": senses}
        notes = [] if senses else [f"no independent definition; run-on of {parent['headword']}"]
        return self.child(id_, "derived", "runon", headword, unit, parent, self.pronunciations(own(self.at.codes)), group, notes) if headword else None

    def child(self, id_: str, kind: str, relation: str, headword: str, unit: Unit, parent: dict, prons: list, group: dict, notes: list[str]) -> dict:
        return {
            "id": id_, "kind": kind, "headword": headword, "homograph": None, "pronunciations": prons, "frequency": None, "inflections": [], "groups": [group], "phrases": [],
            "cross_refs": self.references(unit), "parent": {"id": parent["id"], "headword": parent["headword"], "relation": relation}, "notes": notes,
        }

    def entries(self) -> list[dict]:
        out = []
        if self.too_deep:
            self.issues.append("too_deep")
        for unit in [] if self.too_deep else self.page.units:
            if not any(unit.every(name, "sense", "subsense") for name in self.at.headword[:1]):
                continue  # a box of another kind
            word = self.main(unit)
            if word is None:
                continue
            inner = list(unit.within())
            found = [word, *(self.phrasal(u, word) for u in inner if u.role == "phrasal"), *(self.runon(u, word) for u in inner if u.role == "runon")]
            out += [e for e in found if e]
        return out


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", loose_key(text)).strip("-")[:80] or "x"


def walk_tree(senses: Iterable[dict]) -> Iterator[dict]:
    todo = [*reversed(list(senses))]
    while todo:
        sense = todo.pop()
        yield sense
        todo.extend(reversed(sense["senses"]))


def postings(entry: dict, extra: Iterable[tuple[str, str]]) -> list[tuple]:
    """(norm, sense_id, match, key_raw), once each: names of the entry, then what its senses and phrases are found by."""
    hits: dict[tuple, None] = {}

    def add(raw: str, match: str, sense: str | None = None) -> None:
        hits.update(((norm, sense, match, raw), None) for norm in key_pair(raw))

    add(entry["headword"], "headword")
    for form in entry["inflections"]:
        add(form["form"], "inflection")
    for raw, match in extra:
        add(raw, match)
    phrases = [(p["text"], p["type"], None) for p in entry["phrases"]]
    for sense in (s for g in entry["groups"] for s in walk_tree(g["senses"])):
        phrases += [(t, "phrase", sense["id"]) for t in sense["lexunits"]] + [(t, "phrase_pattern", sense["id"]) for t in sense["patterns"]]
    if entry["kind"] == "phrasal_verb":
        phrases.append((entry["headword"], "phrasal_verb", None))
    for text, match, sense in phrases:
        for variant in phrase_keys(text):
            add(variant, match, sense)
    return list(hits)


def parse(key: str | None, html: str | None, hits: bool = True) -> Iterator[dict]:
    """The ENTRY rows of a record, one at least; postings only where they are asked for."""
    record = Record(key or "", html or "")
    found, boxes = record.entries(), len(record.page.units)
    record.release()
    if not found:
        front = not boxes and any(record.at.front_matter in c for c in record.classes)
        yield {"kind_no": 0, "record_kind": "excluded_aux" if front else "error", "issues": record.issues or ["front_matter_not_headword" if front else "no_entry_node"]}
        return
    wanted = loose_key(record.key)
    named = {e["kind"] for e in found if loose_key(e["headword"]) == wanted}
    # a page filed under one of its derived words only points to it
    locator = "derived" in named and not named & {"word", "see_also"}
    defined = any(s["definition"][x] for e in found if e["kind"] == "word" for s in e["groups"][0]["senses"] for x in ("en", "zh"))
    crossed = any(e["kind"] == "see_also" for e in found) and not defined
    name = "converted_derived_locator" if locator else "converted_crossref" if crossed else "converted_partial" if record.issues else "converted"
    for n, e in enumerate(found):
        row = e | {"kind_no": n, "record_kind": name, "display": e["headword"], "pos_groups": _json(e["groups"]), "issues": record.issues}
        if hits:
            here = e["kind"] == "derived" and loose_key(e["headword"]) == wanted
            extra = [(record.key, "mdx_key")] + ([(record.key, "derived_locator")] if here else [])
            row["postings"] = [dict(zip(POSTING, h, strict=True)) for h in postings(e, extra)] if here or not locator else []
        yield row


#: Bounds of a slice of parsed rows: records, and characters of their pages.
SLICE_ROWS, SLICE_CHARS = 1_000, 4 << 20


def _parsed(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (key, ord, value) to rows of the schema: key, ord and columns of ENTRY."""
    hits = "postings" in schema.names
    for batch in batches:
        keys, values = batch.column(0), batch.column(2)
        places: list[int] = []
        rows: list[dict] = []
        begun = size = 0
        for i in range(batch.num_rows):
            value = values[i].as_py()
            for row in parse(keys[i].as_py(), value, hits):
                places.append(i)
                rows.append(row)
            size += len(value or "")
            if i + 1 == batch.num_rows or i + 1 - begun >= SLICE_ROWS or size >= SLICE_CHARS:
                own = [batch.column(c).take(pa.array(places, pa.int32())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([r.get(f.name) for r in rows], f.type) for f in list(schema)[2:])], schema=schema)
                places, rows, begun, size = [], [], i + 1, 0


def split_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (key, value, ord) as pages and as redirects (key, target, ord); a byte order mark is dropped."""
    rows = records.withColumn("value", F.regexp_replace("value", "^\\ufeff", ""))
    link = F.col("value").startswith(LINK)
    target = F.trim(F.regexp_replace(F.substring("value", len(LINK) + 1, 1 << 30), r"[\r\n\x00]+", ""))
    return rows.where(~link), rows.where(link).select("key", target.alias("target"), "ord")


def parse_records(pages: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(key, ord, ENTRY) rows of pages (key, value, ord), or key, ord and the named columns of ENTRY.

    Pages are dealt evenly first: a small file of many pages is one task's input, and the parse costs far more than its rows.
    """
    spark, rows = pages.sparkSession, pages.select("key", "ord", "value")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    entry = T.StructType.fromDDL(ENTRY)
    schema = T.StructType([*rows.schema.fields[:2], *(f for f in entry.fields if columns is None or f.name in set(columns))])
    arrow = to_arrow_schema(schema)
    return rows.repartition(tasks).mapInArrow(lambda batches: _parsed(batches, arrow), schema)
