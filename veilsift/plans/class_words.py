"""Words and marks that tell classes of documents, as ECMAScript expressions with their flags."""

from __future__ import annotations

# Expressions of each class, in the order they are looked for.
#: Payroll documents.
PAYROLL: list[tuple[str, str]] = [
    (r"\bpayslip\b", "i"),
    (r"\bpay\s*stub\b", "i"),
    (r"\bpayroll\b", "i"),
    (r"\bsalary\s*(statement|slip|details)\b", "i"),
    (r"\bnet\s*pay\b", "i"),
    (r"\bgross\s*pay\b", "i"),
    (r"\bdeductions?\b", "i"),
    (r"\btax\s*(withheld|deducted)\b", "i"),
    (r"\bearnings?\s*statement\b", "i"),
    (r"\bemployee\s*id\b", "i"),
    (r"\bpay\s*period\b", "i"),
    (r"\bbasic\s*salary\b", "i"),
    (r"\ballowances?\b", "i"),
    (r"\bovertime\s*pay\b", "i"),
    (r"(?<!\p{L})lönespecifikation(?!\p{L})", "i"),
    (r"(?<!\p{L})lönspec(?!\p{L})", "i"),
    (r"(?<!\p{L})månadslön(?!\p{L})", "i"),
    (r"(?<!\p{L})månlön(?!\p{L})", "i"),
    (r"(?<!\p{L})bruttolön(?!\p{L})", "i"),
    (r"(?<!\p{L})nettolön(?!\p{L})", "i"),
    (r"\bskatteavdrag\b", "i"),
    (r"\ba-skatt\b", "i"),
    (r"(?<!\p{L})lønnslipp(?!\p{L})", "i"),
    (r"(?<!\p{L})månedslønn(?!\p{L})", "i"),
    (r"(?<!\p{L})bruttolønn(?!\p{L})", "i"),
    (r"(?<!\p{L})nettolønn(?!\p{L})", "i"),
    (r"\bskattetrekk\b", "i"),
    (r"(?<!\p{L})lønseddel(?!\p{L})", "i"),
    (r"(?<!\p{L})månedsløn(?!\p{L})", "i"),
    (r"(?<!\p{L})bruttoløn(?!\p{L})", "i"),
    (r"(?<!\p{L})nettoløn(?!\p{L})", "i"),
    (r"(?<!\p{L})n[oó]mina(?!\p{L})", "i"),
    (r"(?<!\p{L})liquidaci[oó]n(?:\s+de\s+sueldo)?(?!\p{L})", "i"),
    (r"\bsalario\b", "i"),
    (r"\bsueldo\b", "i"),
    (r"(?<!\p{L})remuneraci[oó]n(?!\p{L})", "i"),
    (r"(?<!\p{L})recibo\s+de\s+n[oó]mina(?!\p{L})", "i"),
    (r"\bbruto\b", "i"),
    (r"\bneto\b", "i"),
    (r"\bsalario\s+(?:bruto|neto)\b", "i"),
    (r"\bsueldo\s+(?:bruto|neto)\b", "i"),
]
#: Records of employment.
HR: list[tuple[str, str]] = [
    (r"\bemployment\s*(contract|agreement)\b", "i"),
    (r"\bjob\s*offer\b", "i"),
    (r"\bperformance\s*review\b", "i"),
    (r"\btermination\b", "i"),
    (r"\bdisciplinary\b", "i"),
    (r"\bprobation(ary)?\s*period\b", "i"),
    (r"\bonnboarding\b", "i"),
    (r"\bexit\s*interview\b", "i"),
    (r"\bbenefits?\s*enrollment\b", "i"),
    (r"\bstock\s*options?\b", "i"),
    (r"\bbonus\s*(structure|payment)\b", "i"),
    (r"\bpay\s*grade\b", "i"),
    (r"\bsalary\s*band\b", "i"),
    (r"\bcompensation\s*package\b", "i"),
    (r"\bcontrato\s+de\s+trabajo\b", "i"),
    (r"\bempleador\b", "i"),
    (r"\bempleado\b", "i"),
    (r"\btrabajador\b", "i"),
    (r"(?<!\p{L})relaci[oó]n\s+laboral(?!\p{L})", "i"),
    (r"(?<!\p{L})cl[aá]usulas?(?!\p{L})", "i"),
    (r"\bfecha\s+de\s+inicio\b", "i"),
    (r"(?<!\p{L})duraci[oó]n(?:\s+del\s+contrato)?(?!\p{L})", "i"),
    (r"\bdespido\b", "i"),
    (r"\brenuncia\b", "i"),
    (r"\bpuesto\s+de\s+trabajo\b", "i"),
    (r"\bjornada\s+laboral\b", "i"),
]
#: Insurance policies.
INSURANCE: list[tuple[str, str]] = [
    (r"\binsurance\s*polic(?:y|ies)\b", "i"),
    (r"\bpolicyholder\b", "i"),
    (r"\binsured\s*(?:person|party)\b", "i"),
    (r"\bunderwriter\b", "i"),
    (r"\bpremium\s*(?:amount|payment|schedule)\b", "i"),
    (r"\bcoverage\s*(?:period|amount|limit|type)\b", "i"),
    (r"\bdeductible\b", "i"),
    (r"\bclaim\s*(?:number|form|process)\b", "i"),
    (r"\bbenefit\s*(?:schedule|summary)\b", "i"),
    (r"(?<!\p{L})forsikring(?:spolice|sbetingelser|sdækning)(?!\p{L})", "i"),
    (r"\bselvrisiko\b", "i"),
    (r"(?<!\p{L})dæknings?oversigt(?!\p{L})", "i"),
    (r"\bpolicenummer\b", "i"),
    (r"\bforsikringstager\b", "i"),
    (r"\bskadebehandling\b", "i"),
    (r"(?<!\p{L})p[oó]liza(?:\s+de\s+seguro)?(?!\p{L})", "i"),
    (r"\basegurado\b", "i"),
    (r"\baseguradora\b", "i"),
    (r"\bcobertura\b", "i"),
    (r"\bprima(?:\s+de\s+seguro)?\b", "i"),
    (r"\bsiniestro\b", "i"),
    (r"\bcondiciones\s+generales\b", "i"),
    (r"\bseguro\s+(?:de\s+)?(?:vida|auto|hogar|salud|viaje)\b", "i"),
    (r"(?<!\p{L})n[uú]mero\s+de\s+p[oó]liza(?!\p{L})", "i"),
]
#: Medical records.
MEDICAL: list[tuple[str, str]] = [
    (r"\bpatient\s*(id|name|record)\b", "i"),
    (r"\bdiagnosis\b", "i"),
    (r"\bmedical\s*(history|record|report)\b", "i"),
    (r"\btreatment\s*plan\b", "i"),
    (r"\bprescription\b", "i"),
    (r"\blab\s*results?\b", "i"),
    (r"\bblood\s*(test|type|pressure)\b", "i"),
    (r"\bhealth\s*(insurance|record|condition)\b", "i"),
    (r"\bhipaa\b", "i"),
    (r"\bprotected\s*health\s*information\b", "i"),
    (r"\bphi\b", "i"),
    (r"\bmedical\s*leave\b", "i"),
    (r"\bdisability\b", "i"),
    (r"\bworkers?\s*comp(ensation)?\b", "i"),
    (r"\bicd[-\s]?\d", "i"),
    (r"\bcpt\s*code\b", "i"),
    (r"\bpatientjournal\b", "i"),
    (r"\bsundhedsdata\b", "i"),
    (r"\bdiagnose\b", "i"),
    (r"\bbehandling\b", "i"),
    (r"\brecept\b", "i"),
    (r"\bepikrise\b", "i"),
    (r"\banamnese\b", "i"),
    (r"\bjournal\s*nr\b", "i"),
    (r"\bjournalnummer\b", "i"),
    (r"\bsygejournal\b", "i"),
    (r"(?<!\p{L})lægejournal(?!\p{L})", "i"),
    (r"\bhelbredsoplysninger\b", "i"),
    (r"\bsundhedsjournal\b", "i"),
    (r"\bpatientdata\b", "i"),
    (r"\bsjukjournal\b", "i"),
    (r"(?<!\p{L})vårdjournal(?!\p{L})", "i"),
    (r"(?<!\p{L})läkarjournal(?!\p{L})", "i"),
]
#: Patients.
PATIENT: list[tuple[str, str]] = [
    (r"\bpatient\s*(id|name|number|nr)\b", "i"),
    (r"\bpatient\s*:\s*\w", "i"),
    (r"\bpatient\b.*\b(male|female|man|woman|child)\b", "i"),
    (r"\bpatient\s*journal\b", "i"),
    (r"\bcpr[-\s]*nummer\b", "i"),
    (r"\bpersonnummer\b", "i"),
    (r"\bmedical\s*record\b", "i"),
    (r"\bhealth\s*record\b", "i"),
    (r"\bclinical\s*notes?\b", "i"),
    (r"\bdischarge\s*summary\b", "i"),
    (r"\badmission\s*(date|record)\b", "i"),
    (r"\btreatment\s*plan\b", "i"),
    (r"\bprescription\b", "i"),
    (r"\bmedication\s*list\b", "i"),
    (r"\bdiagnosis\s*:\s*\w", "i"),
    (r"\bbehandlingsplan\b", "i"),
    (r"\bsygehistorie\b", "i"),
    (r"\bjournal\s*nr\b", "i"),
    (r"(?<!\p{L})ansvarlig\s*læge(?!\p{L})", "i"),
    (r"(?<!\p{L})kontrol\s*besøg(?!\p{L})", "i"),
]
#: One is enough for payroll.
STRONG_PAYROLL: list[tuple[str, str]] = [
    (r"\bpayslip\b", "i"),
    (r"\bpay\s*stub\b", "i"),
    (r"\bpayroll\b", "i"),
    (r"(?<!\p{L})n[oó]mina(?!\p{L})", "i"),
    (r"(?<!\p{L})liquidaci[oó]n\s+de\s+sueldo(?!\p{L})", "i"),
    (r"(?<!\p{L})recibo\s+de\s+n[oó]mina(?!\p{L})", "i"),
]
#: One is enough for employment.
STRONG_HR: list[tuple[str, str]] = [
    (r"\bemployment\s*contract\b", "i"),
    (r"\bperformance\s*review\b", "i"),
    (r"\btermination\s*notice\b", "i"),
    (r"\bcontrato\s+(?:de\s+)?trabajo\b", "i"),
    (r"\bcontrato\s+individual\s+de\s+trabajo\b", "i"),
    (r"\bcontrato\s+laboral\b", "i"),
    (r"(?<!\p{L})relaci[oó]n\s+laboral(?!\p{L})", "i"),
]
#: One is enough for medical records.
STRONG_MEDICAL: list[tuple[str, str]] = [
    (r"\bmedical\s*(record|history)\b", "i"),
    (r"\bpatient\s*(id|record|name)\b", "i"),
    (r"\bhipaa\b", "i"),
    (r"\bdiagnosis\b", "i"),
    (r"\bpatientjournal\b", "i"),
    (r"\bsundhedsdata\b", "i"),
    (r"\bsygejournal\b", "i"),
    (r"(?<!\p{L})lægejournal(?!\p{L})", "i"),
    (r"\bepikrise\b", "i"),
    (r"\b[A-Z]\d{2}\.\d{1,2}\b", ""),
]
#: Tickets and travel.
TICKET: list[tuple[str, str]] = [
    (r"\bboarding\s*pass\b", "i"),
    (r"\b(?:concert|event|train|ferry|bus)\s+ticket\b", "i"),
    (r"\bflight\s*(?:number|no\.?|#)\b", "i"),
    (r"\bflight\s*[:#]?\s*[A-Z]{2}\d+\b", "i"),
    (r"\bcheck-?in\b", "i"),
    (r"\be-?ticket\b", "i"),
    (r"\bconfirmation\s*(?:number|code|#)\b", "i"),
    (r"\bbooking\s*(?:ref|reference|number|no\.?|#|code)\b", "i"),
    (r"\breservation\b", "i"),
    (r"\bgate\s*[:#]?\s*(?:number|no\.?|#)?\s*[A-Z]?\d+\b", "i"),
    (r"\bseat\s*[:#]?\s*(?:number|no\.?)?\s*\d+[A-Z]?\b", "i"),
    (r"\bdeparture\s*[:#]?\s*(?:time|gate|terminal)\b", "i"),
    (r"\barrival\s*[:#]?\s*(?:time|terminal)\b", "i"),
    (r"\bpassenger\s*name\b", "i"),
    (r"\bpassenger\s*[:#]", "i"),
    (r"\bbillet\b", "i"),
    (r"\bbookingnr\.?\b", "i"),
    (r"\brejsebetingelser\b", "i"),
    (r"\bafrejse\b", "i"),
    (r"\bankomst\b", "i"),
    (r"\bsejlads\b", "i"),
    (r"(?<!\p{L})færge(?!\p{L})", "i"),
    (r"\bafgang\b", "i"),
    (r"\btogbillet\b", "i"),
    (r"\bbillett\b", "i"),
    (r"\bbestillingsnr\.?\b", "i"),
    (r"\bavgang\b", "i"),
    (r"\bankomst\b", "i"),
    (r"\bferge\b", "i"),
    (r"\bbiljett\b", "i"),
    (r"\bbokningsnr\.?\b", "i"),
    (r"(?<!\p{L})avgång(?!\p{L})", "i"),
    (r"\bankomst\b", "i"),
    (r"(?<!\p{L})färja(?!\p{L})", "i"),
    (r"\bfahrkarte\b", "i"),
    (r"\bflugschein\b", "i"),
    (r"\bbuchungsnummer\b", "i"),
    (r"\babflug\b", "i"),
    (r"\bankunft\b", "i"),
    (r"\btarjeta\s+de\s+embarque\b", "i"),
    (r"(?<!\p{L})n[uú]mero\s+de\s+(?:vuelo|reserva|confirmaci[oó]n)(?!\p{L})", "i"),
    (r"\bsalida\b", "i"),
    (r"\bllegada\b", "i"),
    (r"\bpasajero\b", "i"),
    (r"\badmission\b", "i"),
    (r"\bevent\s*ticket\b", "i"),
    (r"\bentry\s*(?:ticket|pass)\b", "i"),
    (r"\bconcert\s*ticket\b", "i"),
]
#: Bank transfers.
TRANSFER: list[tuple[str, str]] = [
    (r"\b(?:wire|bank)\s*transfer\b", "i"),
    (r"\btransfer\s*(?:to|funds?\s+to)\b", "i"),
    (r"\bpay\s*(?:to|into)\s*(?:account|iban)\b", "i"),
    (r"\bsend\s*(?:to|funds?\s+to)\b", "i"),
    (r"\bremit(?:tance)?\b", "i"),
    (r"\bbeneficiary\b", "i"),
    (r"\bpayment\s*details?\b", "i"),
    (r"\bbank\s*details?\b", "i"),
    (r"(?<!\p{L})overførsel(?!\p{L})", "i"),
    (r"(?<!\p{L})bankoverførsel(?!\p{L})", "i"),
    (r"\bbetal\s*til\b", "i"),
    (r"\bkonto\s*(?:nummer|nr\.?)\b", "i"),
    (r"(?<!\p{L})overføring(?!\p{L})", "i"),
    (r"\bbetal\s*til\b", "i"),
    (r"(?<!\p{L})överföring(?!\p{L})", "i"),
    (r"\bbetala\s*till\b", "i"),
    (r"(?<!\p{L})überweisung(?!\p{L})", "i"),
    (r"\bzahlen\s*(?:an|auf)\b", "i"),
    (r"\btransferencia(?:\s+bancaria)?\b", "i"),
    (r"\bpagar\s*a\b", "i"),
    (r"\benviar\s*a\b", "i"),
]
#: Resumes.
RESUME: list[tuple[str, str]] = [
    (r"\bresume\b", "i"),
    (r"\bcurriculum\s*vitae\b", "i"),
    (r"\b(?:cv|c\.v\.)\b", "i"),
    (r"\bemployment\s+history\b", "i"),
    (r"\bwork\s+history\b", "i"),
    (r"\bprofessional\s+(?:summary|profile)\b", "i"),
    (r"\bcareer\s+(?:summary|objective|highlights?)\b", "i"),
    (r"\blebenslauf\b", "i"),
    (r"\bberufserfahrung\b", "i"),
    (r"\bmeritförteckning\b", "i"),
    (r"\barbejdserfaring\b", "i"),
]
#: Invoices, three points each.
INVOICE_STRONG: list[tuple[str, str]] = [
    (r"\binvoice\s*(?:number|no\.?|#|nr)\b", "i"),
    (r"\breceipt\s*(?:number|no\.?|#|nr)\b", "i"),
    (r"\bfaktura(?:nummer|nr|dato)?\b", "i"),
    (r"\brechnung(?:snummer|sdatum)?\b", "i"),
    (r"\bfactura\b", "i"),
    (r"\binvoice\s*date\b", "i"),
    (r"\bbill\s*(?:to|number|no\.?)\b", "i"),
]
#: Invoices, one point each.
INVOICE_WEAK: list[tuple[str, str]] = [
    (r"\btotal\s*(?:amount|due|excl|incl)\b", "i"),
    (r"\bsubtotal\b", "i"),
    (r"\bvat\b", "i"),
    (r"\bmoms\b", "i"),
    (r"\bpayment\s*(?:due|terms|method)\b", "i"),
    (r"\bdue\s*date\b", "i"),
    (r"\bitem\s*description\b", "i"),
    (r"\bunit\s*price\b", "i"),
    (r"\bquantity\b", "i"),
    (r"(?<!\p{L})beløb(?!\p{L})", "i"),
    (r"\biban\b", "i"),
    (r"\bbank\s*(?:account|transfer)\b", "i"),
]
#: Health certificates, three points each.
CERTIFICATE_STRONG: list[tuple[str, str]] = [
    (r"C\s*O\s*V\s*I\s*D", "i"),
    (r"\bvaccin(?:ation|e|ering|erings?bevis)?\b", "i"),
    (r"\btest\s*(?:result|certificate|bevis|attest)\b", "i"),
    (r"(?<!\p{L})prøvesvar(?!\p{L})", "i"),
    (r"(?<!\p{L})testresultat(?!\p{L})", "i"),
    (r"\bcoronapass\b", "i"),
    (r"\bhealth\s*certificate\b", "i"),
    (r"\bimmuni(?:ty|zation)\s*(?:record|certificate|card)\b", "i"),
]
#: Health certificates, one point each.
CERTIFICATE_WEAK: list[tuple[str, str]] = [
    (r"P\s*C\s*R", "i"),
    (r"\bantigen\b", "i"),
    (r"\bpassport\b", "i"),
    (r"P\s*A\s*S\s*S?\s*P\s*O\s*R\s*T", "i"),
    (r"(?<!\p{L})fødselsdato(?!\p{L})", "i"),
    (r"\bdate\s*of\s*birth\b", "i"),
    (r"\bdose\b", "i"),
    (r"\bbooster\b", "i"),
    (r"\bsurname\b", "i"),
    (r"\bgiven\s*name\b", "i"),
]
#: Numbers of clauses.
CLAUSES: list[tuple[str, str]] = [
    (r"\b\d+\.\d+\.\d+\b", ""),
    (r"\b\d+\.\d+(?!\.\d)\b", ""),
    (r"^\s*\d+\.\s+[A-Z]", "m"),
    (r"§\s*\d+", ""),
    (r"\bArticle\s+\d+", "i"),
    (r"\bArtikel\s+\d+", "i"),
    (r"\bClause\s+\d+", "i"),
    (r"\bKlausul\s+\d+", "i"),
    (r"\bPunkt\s+\d+", "i"),
]
#: Signature blocks.
SIGNATURES: list[tuple[str, str]] = [
    (r"_{5,}", ""),
    (r"\bx{3,}_{2,}", "i"),
    (r"Date:\s*[_\/\-\s]+", "i"),
    (r"Dato:\s*[_\/\-\s]+", "i"),
    (r"Datum:\s*[_\/\-\s]+", "i"),
]
#: Electronic signatures.
E_SIGNATURES: list[tuple[str, str]] = [
    (r"docusign", "i"),
    (r"\bsignature\s*id\b", "i"),
    (r"\benvelope\s*id\b", "i"),
    (r"\badobesign\b", "i"),
    (r"\bhelloSign\b", "i"),
    (r"\bpandadoc\b", "i"),
    (r"\bsigneasy\b", "i"),
]
#: Parties of a contract.
PARTIES: list[tuple[str, str]] = [
    (r"\bparty\s*[ab12]\b", "i"),
    (r"\bpart\s*[ab12]\b", "i"),
    (r"\bfirst\s*party\b", "i"),
    (r"\bsecond\s*party\b", "i"),
    (r"\bhereinafter\b", "i"),
    (r"\bherefter\s*kaldet\b", "i"),
]
