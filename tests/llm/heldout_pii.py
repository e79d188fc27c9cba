"""Hand-written sentences with their personal information, for measuring only: nothing is fitted on them.

Spans are marked in the text: ``{e:..}`` email, ``{t:..}`` phone, ``{i:..}`` identity number, ``{s:..}`` street address, ``{n:..}`` name.
"""

import re

TYPES = {"e": "email", "t": "phone", "i": "id_number", "s": "street_address", "n": "person_name"}

MARKED = """
Please loop in {n:Keisha Okonkwo} before Friday.
It was {n:Rajesh Iyer} who found the bug.
My number has changed to {t:415-555-0132}, sorry.
You may dial {t:020 7946 0958} any time.
The parcel went to {s:1200 Pennsylvania Avenue NW} by mistake.
Abita in {s:Via Garibaldi 12} dal 2019.
Her social security number is {i:219-09-9999}, please keep it private.
We met {n:John Miller} at the station.
{n:Anna Kowalska} has moved to another department.
Could you forward this to {e:h.tanaka@sakura-lab.co.jp}?
His mailbox {e:no.reply.peter@posteo.de} is full again.
The nurse, {n:Olga Petrenko}, will ring you tomorrow.
Reach our accountant under {t:+49 30 901820}.
I have lived at {s:27 Acacia Road} since I was a child.
The tenant of {s:4 Privet Drive, Flat 3} complained.
Passport number: {i:X4729183}.
Driving licence no. {i:MORGA753116} was reported stolen.
Send the invoice to {e:billing@northwind.example}, not to the old address.
Tel. {t:(212) 555-0187}, ask for the caretaker.
{n:Fatima Zahra Benali} signed the lease on Monday.
Yesterday {n:Tom Hardwick} resigned.
Nobody told {n:Wei Zhang} about the outage.
According to {n:Priya Raman} the test was never run.
Written by {n:Sven Lindqvist} in 2014.
The landlord is {n:Giulia Ferraro}.
Her mother, {n:Ingrid Solberg}, was born in Bergen.
Kind regards, {n:Emily Thornton}
Mobile: {t:07911 123456}
Fax {t:+33 1 42 68 53 00} is still in use.
The desk phone rings at {t:555-0148 ext. 12}.
Text me at {t:+1 (650) 555-0199} when you land.
WhatsApp {t:+34 612 345 678} para pedidos.
Hello Marcus, no, I meant {n:Marcus Aldridge}.
Dr. {n:Lena Hoffmann} will see you now.
Mr. {n:Dinesh Patel} declined the offer.
The keys are with {n:Beatrix Van Houten}.
We buried the cable in front of {s:88 Harbour Street}.
Delivery to {s:1600 Amphitheatre Parkway} takes two days.
Their office: {s:350 Fifth Avenue, Suite 5100}, on the corner.
He rents a room at {s:15 rue de la Paix}.
National insurance number {i:QQ 12 34 56 C} appears twice.
Tax ID: {i:47 036 892 816}
My SSN, {i:457-55-5462}, leaked last year.
The form asks for the passport number; hers is {i:C01X00T47}.
Medicare number {i:1EG4-TE5-MK73} was visible on the scan.
Aadhaar number {i:2345 6789 0123} must be masked.
Codice fiscale: {i:RSSMRA85T10A562S}
Personal identity number {i:850709-9805} belongs to a minor.
Write to {e:j_doe99@mail.example.com} or phone {t:0161 496 0345}.
{n:Oliver Grant} <{e:oliver.grant@example.org}> wrote:
From: {n:Noor Al-Masri} <{e:noor@almasri.example}>
Contact {n:Pedro Almeida}, {t:+351 912 345 678}.
Please ask {n:Hannah Weiss} for the badge.
I spoke to {n:Caroline Dubois} on Tuesday about the rent.
{n:Samuel Osei} thinks the fence is too high.
The winner was {n:Yuki Nakamura} from class 4b.
Thanks to {n:Ahmed El-Sayed} for the photos.
Their lawyer, {n:Victoria Chandler}, never replied.
Patient: {n:Greta Nilsen}
Author: {n:Luis Ortega}
Guests: {n:Maya Lin}, {n:Carl Benz} and {n:Ruth Adler}.
{n:Jamal Carter} and {n:Sofia Rossi} got married.
The teacher {n:Elena Markova} retired.
A letter for {n:Henry J. Morgan} arrived.
The captain, {n:Aoife Murphy}, lost the toss.
{n:NADIA HUSSAIN} is listed twice.
ask {n:Bruno Costa} if he has the drill
{e:support [at] tinyshop [dot] example} answers within a day.
Mail goes to {e:lukas at berghof dot example}.
reach me via {e:carla(at)studio-nord.example}
Old address {e:FRANK.WOLF@EXAMPLE.NET} bounces.
Ich wohne in der {s:Lindenstraße 14}.
Bitte schicken Sie das Paket an {s:Am Alten Markt 7b}.
{n:Jürgen Brandt} hat gestern angerufen.
Frau {n:Sabine Keller} ist im Urlaub.
Meine Telefonnummer lautet {t:0171 2345678}.
Ruf mich unter {t:+49 (0)89 123456} an.
Die Steuer-ID {i:12 345 678 901} steht auf dem Bescheid.
Personalausweis Nr. {i:L01X00T47} ist abgelaufen.
Das Treffen findet am {s:Kurfürstendamm 195} statt.
Fragen Sie bitte {n:Matthias Vogel} nach dem Schlüssel.
Die Mail von {e:petra.schulz@beispiel.de} kam nie an.
Mein Nachbar heißt {n:Dieter Krause}.
Mit freundlichen Grüßen {n:Anke Petersen}
Unser Hausmeister, {n:Ralf Neumann}, hat frei.
Die Praxis liegt in der {s:Bahnhofstr. 3}.
Sozialversicherungsnummer {i:65 170839 J 003} bitte löschen.
Wir haben {n:Katrin Schäfer} eingestellt.
Reisepass {i:C4VJ0L8R7} wurde gefunden.
J'habite au {s:12 rue Victor Hugo}.
{n:Camille Lefèvre} a oublié son manteau.
Appelez le {t:01 42 68 53 00} avant midi.
Mon voisin {n:Étienne Moreau} déménage.
Son adresse est {s:8 bis, avenue des Ternes}.
Écrivez à {e:marie.durand@exemple.fr} pour le devis.
Numéro de sécurité sociale {i:2 84 05 75 114 006 12} à masquer.
Passeport n° {i:18CI75432} perdu à Nice.
Merci à {n:Mathieu Girard} pour la photo.
Le colis est resté au {s:3 impasse du Moulin}.
Demandez à {n:Chloé Bernard} de signer.
Carte d'identité n° {i:880692310285} périmée.
Mon portable : {t:06 12 34 56 78}.
Le docteur {n:Alain Rousseau} est absent.
Vive en {s:Calle Mayor 21} con su hermana.
{n:Lucía Fernández} llamó ayer por la tarde.
Mi DNI es {i:12345678Z} y caduca pronto.
Llame al {t:+34 91 123 45 67} para reservar.
La señora {n:Carmen Ruiz} no está en casa.
Enviad el paquete a {s:Avenida de la Constitución 9}.
Mi correo es {e:jorge.lopez@ejemplo.es}, gracias.
El contrato lo firmó {n:Diego Navarro}.
NIE: {i:X1234567L}
Pregunta a {n:Marta Iglesias} por las llaves.
Mi jefe, {n:Álvaro Santos}, viaja mucho.
Quedamos en {s:Plaza de España 4} a las ocho.
Il signor {n:Paolo Conti} abita qui.
Chiamami al {t:+39 06 6982 1234}.
Scrivi a {e:luca.bianchi@esempio.it} entro domani.
Het pakket ligt bij {n:Jan de Vries}.
Bel {t:+31 20 123 4567} voor een afspraak.
O senhor {n:Tiago Ferreira} mudou de casa.
A caller from {t:+91 98765 43210} left no name.
The helpline is {t:1-800-555-0123}.
Ring {t:01632 960 123} after six.
{t:(020) 7946 0123} was engaged all morning.
The alarm company's number: {t:+44 1632 960983}
We found {i:AB-1234-5678} under "licence number" in her file; licence number {i:AB-1234-5678}.
Identity card number {i:592837465} was copied.
Please redact social security number {i:123 45 6789} in the minutes.
{s:10 Downing Street} is famous enough.
A fire broke out at {s:221B Baker Street} last night.
They sold the house on {s:742 Evergreen Terrace}.
Meet me outside {s:45 West 12th Street}.
Ship to {s:9 Elm Court, Unit 4}, please.
The clinic moved to {s:100 Main St} in May.
{n:Leila Haddad}, {s:5 Mill Lane}, {t:01632 960 555}
name={n:Viktor Orlov}; mail={e:v.orlov@example.com}; tel={t:+7 495 123 45 67}
{n:Smith, Deborah} is first on the list.
"{n:Isaac Newton-Hale}" was written on the envelope.
""".strip().splitlines()

CLEAN = """
Visit New York in the spring.
Open a Merge Request when you are ready.
The Golden Gate Bridge was closed on Sunday.
Order 4471-2093 left the warehouse.
Invoice number 123-45-6789 is overdue.
Version 10.2.4567 fixes the leak.
The build took 415 555 ms in total.
Figure 12 Main results are shown above.
See section 4 Road safety for details.
The Black Forest is in Germany.
Ticket 850709-9805 was closed yesterday.
User story 12 Park and ride is done.
Call the function with 3 arguments.
npm install @angular/core@17.0.1 failed.
Clone git@github.example:team/repo.git first.
The ratio was 1200:3400 last week.
We sold 250 000 copies in 2019.
Monday Morning Briefing starts at nine.
Click Save Changes to continue.
Pull Request Template was updated.
The United Nations met in Geneva.
Lake Superior froze in January.
Port 8080 and port 8443 are open.
The meeting is at 10:30 on 12 May 2021.
The file is at /usr/local/bin/python3.
Part no. AB-1234-5678 is out of production.
Serial 1EG4-TE5-MK73 belongs to the printer.
SKU 12345678Z costs nine euros.
Batch 2345 6789 0123 was discarded.
Die Deutsche Bahn streikt am Montag.
Der Schwarzwald ist schön im Herbst.
Rechnung 12 345 678 901 ist bezahlt.
La Tour Eiffel est fermée lundi.
Le Monde a publié un article.
La commande 18CI75432 est partie.
El Real Madrid ganó otra vez.
Factura 12345678 pagada el lunes.
The Quick Start Guide needs an update.
Machine Learning Basics is a free course.
Central Park West was quiet.
The Data Team owns the Search Index.
It rained for 40 Days and nights.
2001 A Space Odyssey is on tonight.
Buy 3 Get One Free ends today.
The offset was 555 0148 bytes.
RFC 2822 and ISO 8601 differ.
The look at that dot on the map amused us.
We arrived at noon dot on time.
Add 100 ml of water and stir.
The Great Barrier Reef is shrinking.
North Sea Oil fell by two percent.
Windows Server 2019 must be patched.
Apache License Version 2.0 applies.
The password has 12 characters.
Error 404 Page not found.
Chapter 7 Way of the warrior.
Bus 24 Circle line is late.
She ran 10 miles in 90 minutes.
Temperatures rose by 3.5 degrees.
The Red Cross sent blankets.
Step 5 Close the valve slowly.
Windhoek and Lusaka are capitals.
Room 12 is on the second floor.
El Banco Central subió los tipos.
La Place de la Concorde était vide.
Im Süden Deutschlands regnet es.
At 18:45 the Paris Express departs.
The White House declined to comment.
Spring Boot and Django are frameworks.
The checksum is 3f9a-22bc-8810.
""".strip().splitlines()

_SPAN = re.compile(r"\{([etins]):([^{}]*)\}")


def sentences() -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, its (type, found text) in order) of every sentence."""
    out = []
    for line in MARKED + CLEAN:
        out.append((_SPAN.sub(r"\2", line), [(TYPES[k], v) for k, v in _SPAN.findall(line)]))
    return out
