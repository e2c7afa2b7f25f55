"""The small labelled table from which the finder of personal details is trained.

Sentences are written with slots; slots are filled with invented values: names of random syllables, numbers of random digits. What
stands in [brackets after a kind] is labelled. No value and no sentence of any test table is used: the contexts are of clinics, clubs and travel.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
MARK = {"E": "email", "P": "phone", "I": "id_number", "A": "street_address", "N": "person_name"}

#: Contexts with details; {E} email, {P} phone, {I} identity number, {A} address, {N} name.
WITH = """
my inbox is {E} | inbox {E} works best | escríbale a {E} sobre el viaje | drop a line to {E} or ring {P} | {E} | e-mail: {E} / {P} | {E} never replied | copia para {E} y {E} | tickets go to {E} | ping {E} before noon
post the parcel to {A} and tell {E} | relayed by {E} to {E} | teacher {N} uses {E} | sent by {N} through {E} | in copy: {E} | answer {E} within the week | la maestra {N} usa el buzón {E} | the club newsletter goes to {E} | the mailbox {E} is full | his handle is {E} | buzón {E}
got no reply from {E} | {N} can be found under {E} | {N} {E} | {N}, {E} | {E} is the one to use | is {E} still right | try {E}, then {P} | both {E} and {E} bounce
ring {N} on {P} | dial {P} for {N} | {N} picks up at {P} or {P} | beep me on {P} | I am {N} and my line is {P} | soy {N} y mi celular es {P} | marque a {N}, {P} | teléfono de {N}: {P} | {N} dejó el número {P}
the clinic gave {P} | who rings from {P} every evening | a stranger texted from {P} twice | mobile {P} | cell {P} | mi celular: {P} | text {P} after lunch | {N} {P} | {P} | {N}, {P} | voicemail at {P} | la llamada vino de {P}
does {P} belong to the school | from noon on use {P} | puede marcar {P} | another message from {P} came | pager {P} or a note to {A} | the line {P} of the coach | {N} on {P}, not before ten | {P} rang twice | number for {N} is {P}
the file of {N} lists {K} {I} | {N} is entered with {K} {I} | the guest {N} showed {K} {I} | her {K}: {I} | {K} {I} | {K}: {I} | {K} {I} belongs to {N} | {K} no. {I} | {K} was {I} on the slip | copied {K} {I} from the card | visitor handed over {K} {I} | visitor handed over {I}
cédula o documento {I} de {N} | {N} signed with {K} {I} | su {K} es {I} | la ficha dice {K} {I} | guest {N}, {K} {I}, {E} | guest {N}, {I}, {E} | store {K} {I} in the safe for {N} | store {I} in the safe for {N} | at the desk {N} gave {I} | the form of {N} shows {I} | the driver is {N}, {K} {I} | the passenger is {N} | keep {K} {I} from others | {K} ends up as {I}
meet the guide at {A} | does {N} live at {A} these days | parcels of {N} end up at {A} | gave the bag to {N} at {A} | {N} left {A} in spring | the shop sits at {A} | la señora {N} tiene su tienda en {A} | pick me up from {A} | the chimney of {A} once more | lost cat near {A}, ring {N}
la casa de {A} | noted by {N}, home address {A} | noted by {N}, lives on {A} | the hall at {A} | ship it to {A} | see you at {A} | {A} was flooded | {A} | su taller está en {A} | el taller de {A} | a courier goes to {A} for {N} | our old shop at {A} stands dark | locked out of {A}
the invoice for {A} is overdue | stop by {A} in the morning | the furnace of {A} | papers for {A} | a spare key to {A} | {N} at {A} | {A}, second door | from {A} to {A} by bus
chatted with {N} | platiqué con {N} | cheers, {N} | un abrazo, {N} | about {N} | muchas gracias, {N} | {N}'s car broke down | {N}'s bill is open | check with {N} first | yours, {N} | by {N} | handed in by {N} | {N} | {N} phoned | thanks, {N} | thank you {N}
booking for {N} | guest {N} | my neighbour {N} disagrees | the new coach is {N} | hello {N} | {N} settled in coins | ran into {N} at the gym | el paciente {N} no vino | la doctora {N} avisó | {N} has left | paciente: {N} | {N} asks for a refund | seen by {N} | settled by {N} | {N} and {N} came along | room of {N} | signed, {N} | told by {N}
co-pilot {N} | co-pilot {N}, {K} {I} | the vice-captain {N}, {I}, {E} | ex-coach {N} phoned | co-pilot {N} {P} | text {P} at dawn, the guard is up | {P} by noon, then {P} | the sister of {N} lives near {A} | {N} and {N} split the bill | {N} wanted {P} | a note for {N} at the counter | la cuenta de {N} | talked with {N} about the match | letter of {N} | {N} {E} | {N}, {P} | {N} {P} | soy {N}, mi celular {P} | noted by {N}, lives on {A} | cheers, {N} | chatted with {N} | gave the bag to {N} at {A} | look for {N} under {P} | saludos de {N} | regards {N}
"""
#: Sentences and fragments without personal details, and look-alikes.
WITHOUT = """
{B} dropped in | {B} estimate | {B} billed us | le pagamos a {B} | ring {B} in the morning | {B} did the job | {B} | get a price from {B} | kudos to {B} | talked with {B} | {B} desk | {B}, all settled | the van of {B}
the {D} branch | the {D} binder | {D} branch | a clinic in {D} closed, who knows why | was {M} too much for a haircut in {D} | by {S} | along {S} | the stop on {S} | where {S} ends | in {D} | {D} | beds free in {D} | hotels around {D} | una escuela en {D} | junto a {D} | {D} school | {D} shop
in {D} a guest mostly brings a towel | we saw a wooden chapel close to {D} and the organ was ten years silent | seats in {D} sold out while those in {D} did not | the old clock in {D} stopped | somebody in {D} needs two days for a haircut | a walk through {D} and back
the tour of {D} brings {M} | en {D} la gente trae su comida | junto a {D} vimos una iglesia | from {D} to {D} by train
parcel {O} | bill {O} | licence plate #{O} | docket no. {C} | issue {C} | code {X} | plot {X} | gauge {O} | type {C} | build {V} | area {Z} | seat {O} of {O} | {O} chairs for {O} each | dossier {C} | batch {O} | cheque #{O} | part no. {C} | booking {O} | reference {C} | release {V} | locker {O} | pin {O} | order {O} | permit #{O} | invoice {O} | account {O} | model {C} | meter {O} | check #{O} | case no. {C} | PIN {X} | parcel {X}
parcel {O}, the lid is cracked | docket no. {C}, brakes done | plate #{O}, far away yet lovely | code {X}, {M} down for the trip | type {C} beat the rest | area {Z}, {M} left to pay | {O} chairs for {O} each, {M} in all | gauge {O}, spare tyre for bay 4C | PIN {X}, {M} in cash | case no. {C}, oil changed | order {O}, the wheel squeaks
{U} {U}, {M} {U} {U} | {U} {U}, {M} {U} | {U}, {M} {U} {U} {U} | {U} {U} {U}, {U} {U} | {U} {U}: {M} | {U} {U}, {U} | {U} {U} {O}, {U} {U} | @{H} wrote so online | @{H} has a point | credit to @{H} | follow @{H} | posted by @{H} yesterday
spent {M} on the trip | a bid for the stage: {M} | {M} por el viaje | {M} still open | the ticket used to cost {M} | the total was wrong, {M} too high | would {M} do for a bike | ¿son muchos {M} por un corte? | anything from {M} to {M} is common for a saddle | they asked {M} for it | {M} down, {M} to go
where do I park the van before the match? | may the coach keep my card all season? | There are four of us and the tent leaks. any tips? | Which paper should the vet get first? | Looking for a recipe for plum cake | Am I to bring my own towel to a small hotel?
cómo llego al museo si no pasa el tren | busco ayuda con el equipaje antes del vuelo | ¿quién cuida el perro después de la fiesta? | no contó nada del partido | qué bonito lo del coro | bastante corto | miré la bici con el entrenador | sobra una silla | pintura de la puerta
{U} {U} broken once more, {U} days of work | {U} {U} rattles in any {U} | {U} {U} washed and packed | carried the {U} {U} to the {U} {U} | a bid on the {U} {U}: {M} | spent {M} on the {U} {U} | cheers for the {U} | on {U} {U} | the {U} {U} meant {U} | ring the {U} {U} | miré el {U} de la {U} con el {U} | busco ayuda con la {U} {U} cada {U}
pintura de la {U} | spare {U} {U} for bay 4C | Which {U} {U} goes on the {U} {U}? | May the {U} {U} keep my {U} {U} {U} {U}? | where do I {U} a {U} {U} {U} {U}? | A {U} {U} lists the {U} {U}, but a {U} {U} saw it otherwise | {U} {U} {U} | parts for {U} {U} | a {U} shop in {D} owns a {U} {U}, who cleans it | in {D} the {U} {U} mostly brings a {U} {U} | platiqué con la {U} | chatted with the {U} {U} | store the {U} {U}
{W} | {W} | {W} | {W} | {W}, {W} | {W}, {W} | In {D} {W} | {W} by {D} and {W} | {W} in {D} | En {D} {W} | {W} in {D} | {W} {M} {W} | {W} {M} {W} | {D} branch | {D} branch | {W} {D} {W} | {W} {S} {W}
¿quién cuida la {U} de {U} en {U}? | Tell a {U} {U} to {U} a {U} {U} and then {U} a {U} {U} | just as the {U} {U} wanted {U} a {U} | off the {U} {U} | settled by the {U} | for a {U} {U} | Bring the {U} {U} before you {U} the {U} {U} | each {U} {U} has a {U}, so the {U} {U} stays {U} | La {U} {U} no cabe en el {U}, pero la {U} {U} sí
engine rattles once more, nine days of work | gate squeaks in any wind | ticket printed and packed | carried the drum to the stage | parts for the bike | spare tyre for bay 4C | Choir practice takes patience, and a singer should warm up each time
You can tune the drum alone; only mark the day on the card | Put the ticket and a picture of the bag in one box each month | Nobody enjoys a long queue, but the crowd stayed {M} poorer when the band came | Tell the baker to sift the flour and to weigh the butter
The programme lists the drum, but the singer saw it otherwise | Few people remember to oil the chain in winter, since a dry chain squeaks late | A tidy diary does more for a coach than a new bench | Once the rain stops, the players look for the ball and then for the coach
Ten rows, one drum and a short song: so went the whole show | A stone church takes some {M} a year for candles | Should the ticket get lost, the guest pays for the seat | just as the singer wanted | nice, the drum bit helped | off about the stage | a bit short but nice
ring back on Tuesday | see you at 5 pm on 6/2/2023 | until 2023-08-09 | since June 2020 | {O} weeks early | around 11:45 the bell rang | May sales | the Council wants it | NASA form | Part 4 ticket | ring the desk after lunch | un abrazo | cheers again | mil gracias | about the match | subj: stage | line is busy | mail came back | the singer answered | my line is on the poster
platiqué con el panadero | chatted with the waiter | marque a la recepción | mail me the song | ring me tonight | post the parcel to the baker | please store the song for the coach | does the coach still have the key to the hall | letters still arrive | gave the bag to the guard | left in spring | noted by the waiter
"""
TRADES = "Plumbing|Heating|Roofing|Electric|Painting|Locksmiths|Masonry|Pest Control|Cleaning Company|Snow Removal|Insurance Agency|Property Supply|Appliance Repair|Windows and Doors|Elevator Service|Landscaping|Realty|Management|Bank|Hardware|Services LLC|& Sons|Inc.".split("|")
PLACES = "Heights|Park|Row|Village|Square|Terrace|Hill|Yard|Gardens|Commons|Gate|Oval|Fields|Flats|Springs|Mills|Landing|Junction|Point|Bend|Corner|Grove|Hollow|North|South|Viejo|Alto|Mile|Triangle|Cross|Center|Crossing|Falls|City|Valley|Ridge|Lake|Harbor|Beach|District|Station|Market".split("|")
STREETS = "St|St.|Street|Ave|Ave.|Av|Avenue|Blvd|Boulevard|Rd|Road|Dr|Drive|Ln|Lane|Ct|Court|Pl|Place|Ter|Terrace|Pkwy|Parkway|Way|Cir|Sq".split("|")
TITLES = "Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Miss|Dr|Dr.|Prof.|Sr.|Sra.|Sr|Sra|Srta.|Don|Doña|señor|señora|Señora".split("|")
KEYWORDS = "SSN|ssn|social|social security|social security number|seguro social|soc sec|tax id|Tax ID|TIN|ITIN|EIN|taxpayer id|taxpayer number|DL|D.L.|license|license no.|driver license|driver's license|driving licence|licencia|licencia de conducir|passport|passport no.|Passport #|pasaporte|pasaporte no.|ID|id number|NIF".split("|")
DIGITS = {"en": "zero one two three four five six seven eight nine".split(), "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split()}


#: Share of context words that are made unknown in the sentences for which this is done.
STRANGE = 0.4


class Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, lo: int = 2, hi: int = 3) -> str:
        r = self.r
        onset, vowel, coda = "b|br|c|ch|d|dr|f|g|gr|h|j|k|l|m|n|p|pr|qu|r|s|st|t|th|tr|v|w|y|z".split("|"), "a|e|i|o|u|ia|ei|ou".split("|"), "|||n|r|s|l|ck|nd|x|ss|th|rt|m".split("|")
        return "".join(r.choice(onset) + r.choice(vowel) + r.choice(coda) for _ in range(r.randint(lo, hi))).capitalize()

    def prose(self) -> str:
        """A run of unknown words in lower case among common ones."""
        common = "the a of to and for in on with is was by that which so but or if as at from el la de del los un una y en con que por para si pero al se".split()
        out = [self.r.choice(common) if self.r.random() < 0.45 else self.word(1, 3).lower() for _ in range(self.r.randint(4, 14))]
        text = " ".join(out)
        return text[0].upper() + text[1:] if self.r.random() < 0.5 else text

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def surname(self) -> str:
        r = self.r
        s = self.word(2, 4)
        if r.random() < 0.2:
            s += "-" + self.word(1, 2)
        elif r.random() < 0.08:
            s = r.choice(["Mc", "O'", "Van", "De"]) + s
        return s

    def name(self) -> tuple[str, str]:
        """What stands before the name, and the name."""
        r, first, last = self.r, self.word(1, 3), self.surname()
        k = r.random()
        before, n = "", f"{first} {last}"
        if k < 0.12:
            before, n = r.choice(TITLES) + " ", last
        elif k < 0.2:
            before = r.choice(TITLES) + " "
        elif k < 0.3:
            n = f"{first[0]}. {last}"
        elif k < 0.38:
            n = f"{first} {self.word(1, 1)[0]}. {last}"
        elif k < 0.48:
            n = f"{last}, {first}"
        elif k < 0.53:
            n = f"{first} {self.word(1, 3)} {last}"
        if r.random() < 0.15:
            n = n.upper()
        elif r.random() < 0.14:
            n = n.lower()
        return before, n

    def email(self) -> str:
        r, a, b = self.r, self.word(1, 3).lower(), self.word(2, 4).lower()
        user = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{a}{self.digits(2)}", f"{a}_{self.digits(2)}", f"{b}+{r.choice(['rent', 'home', 'bills'])}", f"{b}-{a[0]}", f"{a}.{b}{self.digits(1)}", a])
        host, end = r.choice([self.word(1, 3).lower(), f"my-{self.word(1, 2).lower()}", f"{self.word(1, 2).lower()}.{self.word(1, 2).lower()}"]), r.choice("com org net example test invalid mx es info".split())
        k = r.random()
        if k < 0.7:
            e = f"{user}@{host}.{end}"
        elif k < 0.8:
            e = f"{user} at {host} dot {end}"
        elif k < 0.88:
            e = f"{user} ({r.choice(['at', 'AT', 'arroba'])}) {host}.{end}"
        elif k < 0.92:
            e = f"{user} [at] {host}.{end}"
        elif k < 0.94:
            e = f"{user}[at]{host}[dot]{end}".replace(".", "[dot]")
        elif k < 0.96:
            e = f"{user} arroba {host} punto {end}"
        elif k < 0.99:
            e = f"{user} @ {host}.{end}"
        else:
            e = f"{user}@{host} dot {end}"
        return e.upper() if r.random() < 0.12 else e

    def phone(self) -> str:
        r, a, b, c = self.r, self.digits(3), self.digits(3), self.digits(4)
        k = r.random()
        if k < 0.14:
            w = DIGITS["en" if r.random() < 0.8 else "es"]
            return " ".join(w[int(x)] for x in r.choice([a + b + c, b + c]))
        sep = r.choice(["-", ".", " ", "–", "/", ""])
        tail = r.choice(["-", ".", " ", "–"]) if sep == "/" else sep
        core = r.choice([f"{a}{sep}{b}{tail}{c}"] * 4 + [f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b} {c}", f"{b}-{c}"])
        lead = r.choice([""] * 6 + ["+1 ", "+1", "1-", "+1-", "1 "])
        return core if core[0] == "(" and r.random() < 0.6 or len(core) < 9 else lead + core

    def ident(self) -> str:
        r, d = self.r, self.digits
        sep = r.choice(["-", "-", ".", " ", ""])
        letter = r.choice("ABCDEFGHJKLMNPRSTVW")
        return r.choice([f"{d(3)}{sep}{d(2)}{sep}{d(4)}"] * 5 + [f"{d(2)}-{d(7)}", f"{letter}{d(3)}-{d(4)}-{d(4)}", f"{letter}{d(3)} {d(4)} {d(4)}", f"{letter}{d(3)}.{d(4)}.{d(4)}", f"{letter}{d(11)}", f"{letter}{d(8)}", d(9), f"{letter}{letter}{d(7)}", f"{letter}{d(7)}", f"XXX-XX-{d(4)}"])

    def address(self) -> str:
        r = self.r
        n = r.choice([self.digits(4), self.digits(4), self.digits(3), self.digits(2), f"{self.digits(4)}-{self.digits(4)}"])
        n = str(r.randint(1, 9)) + n[1:]
        s = r.choice([self.word(2, 3), f"{self.word(1, 2)}-{self.word(1, 2)}", f"{self.word(1, 2)} {self.word(1, 2)}", f"{self.digits(2)}th"])
        if r.random() < 0.15:
            a = f"{r.choice(['Calle', 'Avenida', 'Av.', 'Camino', 'Paseo', 'calle'])} {self.word(2, 3)} {r.choice(['', '', '', '#', 'No. ', 'núm. ', 'No '])}{n}"
        else:
            way = r.choice(["", "", "N ", "S ", "W ", "E ", "N. ", "W. ", "w ", "e ", "North ", "West ", "East ", "South ", "NW "])
            a = f"{n} {way}{s} {r.choice(STREETS)}" + r.choice([""] * 5 + [" #" + self.digits(1), " apt. " + self.digits(1), " Apt " + self.digits(1), " Unit 2B", ", Apt 3", " apt " + self.digits(2)])
        k = r.random()
        return a.upper() if k < 0.08 else a.lower() if k < 0.16 else a

    def estrange(self, text: str) -> str:
        """Text with some words replaced by unknown ones, so that the finder doesn't lean on the few contexts it has seen."""
        return re.sub(r"\b[a-zñáéíóú]{2,}\b", lambda m: self.word(1, 2).lower() if self.r.random() < STRANGE else m.group(), text)

    def fill(self, template: str, strange: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
        """A sentence and the (start, end, kind) in it; strange: its context is partly of unknown words."""
        r, out, marks = self.r, "", []
        for part in re.split(r"(\{\w\})", template):
            slot = part[1] if re.fullmatch(r"\{\w\}", part) else ""
            if slot in MARK:
                before, value = self.name() if slot == "N" else ("", {"E": self.email, "P": self.phone, "I": self.ident, "A": self.address}[slot]())
                out += before
                marks.append((len(out), len(out) + len(value), MARK[slot]))
                out += value
            elif slot:
                out += {
                    "K": lambda: r.choice(KEYWORDS), "B": lambda: f"{self.word()} {r.choice(TRADES)}", "D": lambda: r.choice([f"{self.word(2, 3)} {r.choice(PLACES)}", f"{self.word(1, 2)} {r.choice(PLACES)}", f"{self.word(1, 2)} {self.word(1, 1)} {r.choice(PLACES)}", self.word(3, 4), f"{r.choice(['Port', 'Fort', 'Saint', 'Mount', 'Upper', 'Lower', 'Old', 'Little'])} {self.word()}"]),
                    "S": lambda: f"{self.word(2, 3)} {r.choice(STREETS)}", "M": lambda: r.choice([f"${r.randint(1, 9)},{self.digits(3)}", f"${r.randint(10, 990)}", f"${r.randint(1, 9)}k"]), "O": lambda: str(r.randint(1, 9)) + self.digits(r.choice([1, 1, 2, 3, 4, 9, 9, 11, 11])),
                    "C": lambda: r.choice([f"20{self.digits(2)}-{self.digits(2)}-{self.digits(5)}", f"{self.digits(4)}-{self.digits(2)}", f"{self.digits(2)}-{self.digits(3)}-{self.digits(4)}"]), "X": lambda: f"{self.digits(2)}-{self.digits(2)}-{self.digits(3)}-{self.digits(3)}-{self.digits(4)}",
                    "V": lambda: f"{self.digits(1)}.{self.digits(2)}.{self.digits(3)}", "Z": lambda: f"{r.choice('ABCR')}{self.digits(2)}-{self.digits(3)}", "H": lambda: self.word(1, 3).lower(), "W": self.prose, "U": lambda: self.word(1, 3).lower() if r.random() < 0.9 else f"{self.word(1, 2)}-{self.word(1, 2)}".lower(),
                }[slot]()
            else:
                out += self.estrange(part) if strange else part
        if r.random() < 0.12 and out[:1].isascii():
            cap = out[:1].upper() + out[1:]
            out = cap if not marks or marks[0][0] else out
        return out, marks


def labelled(rows: int = 5000, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: rows sentences, each of one or two fragments, with their marked details."""
    split = lambda s: [x.strip() for line in s.strip().split("\n") for x in line.split(" | ")]
    yes, no = split(WITH), split(WITHOUT)
    f, out = Filler(seed), []
    for _ in range(rows):
        first = f.r.choice(yes if f.r.random() < 0.6 else no)
        text, marks = f.fill(first, "{" in first and "{O}" not in first and f.r.random() < 0.6)
        if f.r.random() < 0.55:
            glue = f.r.choice([" ", ", ", "; ", " / ", " - ", ". ", ": "])
            more, extra = f.fill(f.r.choice(no if marks and f.r.random() < 0.7 else yes if f.r.random() < 0.5 else no))
            base = len(text) + len(glue)
            text, marks = text + glue + more, marks + [(a + base, b + base, k) for a, b, k in extra]
        text += f.r.choice(["", "", "", ".", "!", "?"])
        out.append((text, marks))
    return out
