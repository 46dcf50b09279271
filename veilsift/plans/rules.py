"""Detection rules: what each looks for, how it counts and how severe a hit is.

The regular expressions are ECMAScript ones; ``veilsift.functions.patterns`` turns them into Java's.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pack: str
    id: str
    name: str
    type: str
    severity: str
    regex: str
    flags: str
    description: str
    min_count: int = 0  # 0: presence of one match
    count_text: str = ""
    floor: bool = False
    cap: str = ""


# Ids, names, types, severities, texts and expressions of the detection packs.
RULES = [
    Rule('global', 'global-api-key-sk', 'API Key (sk-)', 'confidential', 'critical', r'\b(sk-[a-zA-Z0-9]{20,})\b', '', 'API key pattern', floor=True),
    Rule('global', 'global-api-key-pk', 'API Key (pk_)', 'confidential', 'critical', r'\b(pk_[a-zA-Z0-9_]{20,})\b', '', 'API key pattern', floor=True),
    Rule('global', 'global-api-key-generic', 'API Key (generic)', 'confidential', 'critical', r'''\b(api[_-]?key|apikey)\s*[:=]\s*['"]?([a-zA-Z0-9_-]{20,})['"]?''', 'i', 'API key pattern', floor=True),
    Rule('global', 'global-bearer-token', 'Bearer Token', 'confidential', 'critical', r'\bbearer\s+[a-zA-Z0-9_-]{20,}', 'i', 'Bearer token detected', floor=True),
    Rule('global', 'global-aws-access-key', 'AWS Access Key', 'confidential', 'critical', r'\bAKIA[0-9A-Z]{16}\b', '', 'AWS access key', floor=True),
    Rule('global', 'global-password-assignment', 'Password Assignment', 'confidential', 'critical', r'''\b(password|passwd|pwd)\s*[:=]\s*['"]?[^\s'"]{4,}['"]?''', 'i', 'Password detected', floor=True),
    Rule('global', 'global-private-key', 'Private Key', 'confidential', 'critical', r'-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----', '', 'Private key detected', floor=True),
    Rule('global', 'global-connection-string', 'Database Connection String', 'confidential', 'critical', r'\b(mongodb|postgres|mysql|redis):\/\/[^\s]+:[^\s]+@[^\s]+', 'i', 'Database credentials', floor=True),
    Rule('global', 'global-url-credentials', 'URL with Credentials', 'confidential', 'critical', r'https?:\/\/[^:]+:[^@]+@[^\s]+', 'i', 'URL with embedded credentials', floor=True),
    Rule('global', 'global-url-query-credentials', 'URL with Credential Parameters', 'confidential', 'critical', r'https?:\/\/[^\s]+[?&](password|passwd|pwd|pass|secret|token|api_key|apikey)=[^\s&]{4,}', 'i', 'URL with credential query parameters', floor=True),
    Rule('global', 'global-email', 'Email Addresses', 'pii', 'low', r'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '', 'Email addresses', min_count=5, count_text='{count} email addresses', cap='medium'),
    Rule('global', 'global-credit-card', 'Credit Card Number', 'financial', 'critical', r'\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b', '', 'Payment card pattern', floor=True),
    Rule('global', 'global-dk-cpr', 'Danish CPR Number', 'pii', 'critical', r'\b(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])(\d{2})-?(\d{4})\b', '', 'Danish national ID (CPR number)', floor=True),
    Rule('global', 'global-se-personnummer', 'Swedish Personnummer', 'pii', 'critical', r'\b(?:(?:19|20)\d{2}|\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01]|6[1-9]|[78]\d|9[01])\s*[-+]\s*(\d{4})\b', '', 'Swedish national ID (personnummer)', floor=True),
    Rule('global', 'global-no-fnr', 'Norwegian Fødselsnummer', 'pii', 'critical', r'\b(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])(\d{2})(\d{5})\b', '', 'Norwegian national ID (fødselsnummer)', floor=True),
    Rule('global', 'global-fi-hetu', 'Finnish HETU', 'pii', 'critical', r'\b(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(\d{2})[-+A-Ya-y](\d{3})([0-9A-Ya-y])\b', '', 'Finnish national ID (henkilötunnus / HETU)', floor=True),
    Rule('global', 'global-de-steuer-id', 'German Steuer-ID', 'pii', 'critical', r'\b([1-9]\d{10})\b', '', 'German tax identification number (Steuer-ID)', floor=True),
    Rule('global', 'global-es-dni-nie', 'Spanish DNI / NIE', 'pii', 'critical', r'\b(?:[XYZxyz]\d{7}|[1-9]\d{7})[A-Za-z]\b', '', 'Spanish national ID (DNI / NIE)', floor=True),
    Rule('global', 'global-it-codice-fiscale', 'Italian Codice Fiscale', 'pii', 'critical', r'\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\b', 'i', 'Italian tax code (Codice Fiscale)', floor=True),
    Rule('global', 'global-pl-pesel', 'Polish PESEL', 'pii', 'critical', r'\b\d{11}\b', '', 'Polish national ID (PESEL)', floor=True),
    Rule('global', 'global-nl-bsn', 'Dutch BSN', 'pii', 'critical', r'\b\d{9}\b', '', 'Dutch national ID (BSN / Burgerservicenummer)', floor=True),
    Rule('global', 'global-fr-nir', 'French NIR / INSEE', 'pii', 'critical', r'\b[12]\s?\d{2}\s?(?:0[1-9]|1[0-2]|[2-9]\d)\s?(?:\d{2}|2[ABab])\s?\d{3}\s?\d{3}\s?\d{2}\b', 'i', 'French national ID (NIR / numéro de sécurité sociale)', floor=True),
    Rule('global', 'global-pt-nif', 'Portuguese NIF', 'pii', 'critical', r'\b\d{9}\b', '', 'Portuguese national tax ID (NIF / Número de Identificação Fiscal)', floor=True),
    Rule('global', 'global-be-nn', 'Belgian National Number', 'pii', 'critical', r'\b\d{2}[.,\s]\d{2}[.,\s]\d{2}[-–\s]\d{3}[.,\s]\d{2}\b', '', 'Belgian national register number (Rijksregisternummer / Numéro national)', floor=True),
    Rule('global', 'global-br-cpf', 'Brazilian CPF', 'pii', 'critical', r'\b\d{3}[.,]\d{3}[.,]\d{3}-\d{2}\b', '', 'Brazilian taxpayer ID (CPF / Cadastro de Pessoas Físicas)', floor=True),
    Rule('global', 'global-br-cnpj', 'Brazilian CNPJ', 'pii', 'critical', r'\b\d{2}[.,]\d{3}[.,]\d{3}\/\d{4}-\d{2}\b', '', 'Brazilian company tax ID (CNPJ / Cadastro Nacional da Pessoa Jurídica)', floor=True),
    Rule('global', 'global-mx-curp', 'Mexican CURP', 'pii', 'critical', r'\b[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d\b', 'i', 'Mexican population registry key (CURP / Clave Única de Registro de Población)', floor=True),
    Rule('global', 'global-mx-rfc', 'Mexican RFC', 'pii', 'critical', r'\b[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}\b', 'i', 'Mexican taxpayer ID (RFC / Registro Federal de Contribuyentes)', floor=True),
    Rule('global', 'global-ar-cuil', 'Argentine CUIL/CUIT', 'pii', 'critical', r'\b\d{2}-\d{8}-\d\b', '', 'Argentine tax/labor identifier (CUIL / CUIT)', floor=True),
    Rule('global', 'global-cl-rut', 'Chilean RUT/RUN', 'pii', 'critical', r'\b\d{1,2}[.,]\d{3}[.,]\d{3}-[0-9Kk]\b', '', 'Chilean tax/civil identifier (RUT / RUN)', floor=True),
    Rule('global', 'global-cl-rut-bare', 'Chilean RUT/RUN (bare format)', 'pii', 'critical', r'\b\d{7,8}-[0-9Kk]\b', '', 'Chilean tax/civil identifier (RUT/RUN) — bare dash format', floor=True),
    Rule('global', 'global-ie-pps', 'Irish PPS Number', 'pii', 'critical', r'\b\d{7}[A-W]{1,2}\b', '', 'Irish Personal Public Service (PPS) Number', floor=True),
    Rule('global', 'global-at-sv-nr', 'Austrian SV-Nr', 'pii', 'critical', r'\b\d{4}[\s]\d{6}\b', '', 'Austrian Sozialversicherungsnummer (SV-Nr)', floor=True),
    Rule('global', 'global-ro-cnp', 'Romanian CNP', 'pii', 'critical', r'\b[1-8]\d{12}\b', '', 'Romanian personal numeric code (CNP / Cod Numeric Personal)', floor=True),
    Rule('global', 'global-cz-rc', 'Czech/Slovak Rodné číslo', 'pii', 'critical', r'\b\d{6}\/\d{4}\b', '', 'Czech / Slovak birth number (Rodné číslo)', floor=True),
    Rule('global', 'global-hu-taj', 'Hungarian TAJ', 'pii', 'critical', r'\b\d{3} \d{3} \d{3}\b', '', 'Hungarian social insurance number (TAJ — Társadalombiztosítási Azonosító Jel)', floor=True),
    Rule('global', 'global-uk-nin', 'UK National Insurance Number', 'pii', 'critical', r'\b(?!(?:BG|GB|NK|KN|TN|NT|ZZ))[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b', 'i', 'UK National Insurance Number (NIN / NINO)', floor=True),
    Rule('global', 'global-au-tfn', 'Australian Tax File Number', 'pii', 'critical', r'\b\d{3} \d{3} \d{3}\b', '', 'Australian Tax File Number (TFN)', floor=True),
    Rule('global', 'global-au-abn', 'Australian Business Number', 'pii', 'critical', r'\b\d{2} \d{3} \d{3} \d{3}\b', '', 'Australian Business Number (ABN)', floor=True),
    Rule('global', 'global-ca-sin', 'Canadian Social Insurance Number', 'pii', 'critical', r'\b\d{3}-\d{3}-\d{3}\b', '', 'Canadian Social Insurance Number (SIN / NAS)', floor=True),
    Rule('global', 'global-confidential-en', 'Confidentiality Marker (English)', 'confidential', 'high', r'''\b(confidential|secret(?![\s\-'"]*sauce)|classified|internal\s+only|restricted|proprietary|do\s+not\s+distribute)\b''', 'i', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-de', 'Confidentiality Marker (German)', 'confidential', 'high', r'(?<!\p{L})(vertraulich|geheim|streng\s+vertraulich|nur\s+für\s+den\s+internen\s+gebrauch)(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-fr', 'Confidentiality Marker (French)', 'confidential', 'high', r'''\b(confidentiel|secret(?![\s\-'"]*sauce)|usage\s+interne|ne\s+pas\s+diffuser)\b''', 'i', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-es', 'Confidentiality Marker (Spanish)', 'confidential', 'high', r'\b(confidencial|secreto|uso\s+interno|no\s+distribuir)\b', 'i', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-nordic', 'Confidentiality Marker (Nordic)', 'confidential', 'high', r'(?<!\p{L})(fortrolig|hemmelig|intern\s+brug|konfidentiell|hemlig|luottamuksellinen|salainen|sis[aä]inen\s+k[aä]ytt[oö])(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-nl', 'Confidentiality Marker (Dutch)', 'confidential', 'high', r'(?<!\p{L})(vertrouwelijk|geheim|strikt\s+vertrouwelijk|intern\s+gebruik|niet\s+verspreiden)(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-it', 'Confidentiality Marker (Italian)', 'confidential', 'high', r'(?<!\p{L})(confidenziale|riservato|strettamente\s+riservato|uso\s+interno|non\s+divulgare)(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-pt', 'Confidentiality Marker (Portuguese)', 'confidential', 'high', r'(?<!\p{L})(reservado|restrito|estritamente\s+confidencial|n[aã]o\s+distribuir)(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-pl', 'Confidentiality Marker (Polish)', 'confidential', 'high', r'(?<!\p{L})(poufne|tajne|zastrze[zż]one|do\s+u[zż]ytku\s+wewn[eę]trznego|nie\s+rozpowszechnia[cć])(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-ro', 'Confidentiality Marker (Romanian)', 'confidential', 'high', r'(?<!\p{L})(uz\s+intern|pentru\s+uz\s+intern|clasificat|restric[tț]ionat|nu\s+distribui[tț]i)(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-cz', 'Confidentiality Marker (Czech/Slovak)', 'confidential', 'high', r'(?<!\p{L})(d[uů]věrn[eé]|tajn[eé]|p[rř][ií]sně\s+d[uů]věrn[eé]|interní\s+dokument|nerozšiřovat|dôvern[eé]|prísne\s+dôvern[eé]|nešíri[tť])(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-confidential-hu', 'Confidentiality Marker (Hungarian)', 'confidential', 'high', r'(?<!\p{L})(bizalmas|titkos|szigor[uú]an\s+bizalmas|bels[oő]\s+haszn[aá]latra|nem\s+terjesztend[oő]|nem\s+sokszoros[ií]that[oó])(?!\p{L})', 'iu', 'Confidentiality marker in text', floor=True),
    Rule('global', 'global-us-privacy-law', 'US Privacy Law Reference', 'confidential', 'high', r'\b(HIPAA|CCPA|FERPA|COPPA|GLBA|protected\s+health\s+information|personally\s+identifiable\s+information)\b', 'i', 'US privacy law or regulated data category reference', floor=True),
    Rule('global', 'global-ma-terms', 'M&A Terminology', 'confidential', 'critical', r'\b(?:term\s+sheet|target\s+company|letter\s+of\s+intent|(?:acquisition|merger|due\s+diligence)\s+(?:\w+\s+){0,8}?(?:deal|transaction|buyer|seller|shareholders?|purchase\s+agreement|share\s+purchase|equity\s+stake|divestiture|target\s+company|term\s+sheet|letter\s+of\s+intent)|(?:deal|transaction|buyer|seller|shareholders?|purchase\s+agreement|share\s+purchase|equity\s+stake|divestiture|target\s+company|term\s+sheet|letter\s+of\s+intent)\s+(?:\w+\s+){0,8}?(?:acquisition|merger|due\s+diligence))\b', 'i', 'M&A content detected', floor=True),
    Rule('global', 'global-ma-valuation-context', 'M&A Valuation (Context-Gated)', 'confidential', 'high', r'\b(?:(?:acquisition|merger|deal|transaction|target|company)\s+(?:\w+\s+){0,5}valuation|valuation\s+(?:\w+\s+){0,5}(?:of\s+)?(?:acquisition|merger|deal|transaction|target|company))\b', 'i', 'M&A valuation context detected', cap='critical'),
    Rule('global', 'registry-ssn-us', 'US Social Security Number', 'pii', 'critical', r'\b\d{3}-\d{2}-\d{4}\b', '', 'SSN pattern detected', min_count=1, floor=True),
    Rule('global', 'registry-credit-card-spaced', 'Payment Card (Spaced Format)', 'financial', 'critical', r'\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '', 'Payment card pattern', floor=True),
    Rule('global', 'registry-banking-terms', 'Banking Terminology', 'financial', 'high', r'(?<!\p{L})(routing\s+number|swift\s*(?:code|bic)|iban|wire\s+transfer|account\s+number|kontonummer|bankverbindung|[uü]berweisung|kontoauszug|bankleitzahl|compte\s+bancaire|virement|relev[eé]\s+de\s+compte|num[eé]ro\s+de\s+compte|titulaire\s+du\s+compte|solde\s+bancaire|pr[eé]l[eè]vement\s+automatique|domiciliation\s+bancaire|encaissement|facturation|conto\s+corrente|bonifico|estratto\s+conto|numero\s+di\s+conto|fatturazione|partita\s+iva|ricevuta\s+bancaria|addebito\s+diretto|titolare\s+del\s+conto|saldo\s+contabile|bankrekening|rekeningnummer|overschrijving|rekeningoverzicht|cuenta\s+bancaria|transferencia\s+bancaria|n[uú]mero\s+de\s+cuenta|extracto\s+bancario|domiciliaci[oó]n\s+bancaria|titular\s+de\s+cuenta|saldo\s+(?:bancario|disponible|pendiente)|facturaci[oó]n|recibo\s+bancario|conta\s+banc[aá]ria|transfer[eê]ncia\s+banc[aá]ria|n[uú]mero\s+de\s+conta|extracto\s+banc[aá]rio|titular\s+da\s+conta|saldo\s+banc[aá]rio|konto\s+bankowe|przelew\s+bankowy|numer\s+konta|wyci[aą]g\s+bankowy|posiadacz\s+konta|saldo\s+konta|boleto\s+banc[aá]rio|boleto|comprovante\s+de\s+pagamento|CFDI|comprobante\s+fiscal|cont\s+bancar|transfer\s+bancar|extras\s+de\s+cont|num[aă]r\s+de\s+cont|titular\s+de\s+cont|sold\s+bancar|bankovn[ií]\s+[uú][cč]et|bankovn[ií]\s+p[rř]evod|v[yý]pis\s+z\s+[uú][cč]tu|[cč][ií]slo\s+[uú][cč]tu|z[uů]statek|bankov[yý]\s+[uú][cč]et|bankov[yý]\s+prevod|zostatok|banksz[aá]mla|[aá]tutal[aá]s|sz[aá]mlakivonat|sz[aá]mlasz[aá]m|egyenleg)(?!\p{L})', 'iu', 'Banking information', min_count=1),
    Rule('global', 'registry-legal-language', 'Legal Contract Language', 'legal', 'medium', r'(?<!\p{L})(whereas|hereby|indemnify|liability|jurisdiction|arbitration|governing\s+law|force\s+majeure|haftung|gerichtsstand|schiedsverfahren|schadensersatz|h[oö]here\s+gewalt|juridiction|arbitrage|mise\s+en\s+demeure|dommages\s+et\s+int[eé]r[eê]ts|clause|responsabilit[eé]\s+civile|accord\s+de\s+confidentialit[eé]|contrat\s+commercial|p[eé]nalit[eé]\s+contractuelle|r[eé]siliation\s+de\s+contrat|giurisdizione|arbitrato|risarcimento|forza\s+maggiore|clausola|responsabilit[aà]\s+civile|accordo\s+di\s+riservatezza|contratto\s+commerciale|penale\s+contrattuale|risoluzione\s+del\s+contratto|aansprakelijkheid|geschillenbeslechting|schadevergoeding|jurisdictie|overmacht|vertrouwelijkheidsovereenkomst|handelsovereenkomst|jurisdicci[oó]n|arbitraje|indemnizaci[oó]n|fuerza\s+mayor|cl[aá]usula|responsabilidad\s+civil|acuerdo\s+de\s+confidencialidad|contrato\s+mercantil|penalizaci[oó]n|resoluci[oó]n\s+de\s+contrato|jurisdi[cç][aã]o|arbitragem|indemniza[cç][aã]o|for[cç]a\s+maior|responsabilidade\s+civil|contrato\s+comercial|penaliza[cç][aã]o|rescis[aã]o\s+de\s+contrato|jurysdykcja|arbitra[zż]|odszkodowanie|si[lł]a\s+wy[zż]sza|odpowiedzialno[sś][cć]\s+cywilna|umowa\s+handlowa|klauzula|rozwi[aą]zanie\s+umowy|Ley\s+Federal\s+del\s+Trabajo|contrato\s+colectivo\s+de\s+trabajo|jurisdic[tț]ie|arbitraj|desp[aă]gubire|for[tț][aă]\s+major[aă]|responsabilitate\s+civil[aă]|contract\s+comercial|reziliere|jurisdikce|arbitr[aá][zž]|od[sš]kodn[eě]n[ií]|vy[sš][sš][ií]\s+moc|odpov[eě]dnost|jurisdikcia|od[sš]kodnenie|vy[sš][sš]ia\s+moc|joghat[oó]s[aá]g|v[aá]lasztottb[ií]r[oó]s[aá]g|k[aá]rt[eé]r[ií]t[eé]s|felel[oő]ss[eé]g)(?!\p{L})', 'iu', 'Legal language detected', min_count=2, cap='high'),
    Rule('global', 'registry-hr-employee', 'HR/Employee Data', 'pii', 'high', r'(?<!\p{L})(salary|compensation|performance\s+review|termination|disciplinary|employee\s+id|contrato\s+de\s+trabajo|empleador|empleado|trabajador|relaci[oó]n\s+laboral|despido|renuncia|n[oó]mina|sueldo|salario|remuneraci[oó]n|liquidaci[oó]n|gehalt|arbeitsvertrag|arbeitgeber|arbeitnehmer|k[uü]ndigung|abfindung|lohnabrechnung|personalakte|bruttolohn|nettolohn|gehaltsabrechnung|steuerklasse|sozialversicherungsnummer|lohnzettel|contrat\s+de\s+travail|employeur|employ[eé]|salari[eé]|licenciement|indemnit[eé]|r[eé]mun[eé]ration|fiche\s+de\s+paie|contratto\s+di\s+lavoro|datore\s+di\s+lavoro|dipendente|stipendio|retribuzione|licenziamento|busta\s+paga|arbeidsovereenkomst|werkgever|werknemer|salaris|ontslagvergoeding|loonstrook|contrato\s+de\s+trabalho|empregador|empregado|trabalhador|despedimento|sal[aá]rio|remunera[cç][aã]o|recibo\s+de\s+vencimento|vencimento|umowa\s+o\s+prac[eę]|pracodawca|pracownik|wynagrodzenie|zwolnienie|wypowiedzenie|lista\s+p[lł]ac|odprawa|FGTS|INSS|holerite|CLT|d[eé]cimo\s+terceiro|IMSS|INFONAVIT|finiquito|contract\s+de\s+munc[aă]|angajator|angajat|salariu|concediere|demisie|stat\s+de\s+plat[aă]|pracovn[ií]\s+smlouva|zam[eě]stnavatel|zam[eě]stnanec|mzda|v[yý]pov[eě][dď]|odstupn[eé]|pracovn[aá]\s+zmluva|zamestn[aá]vate[lľ]|munkaszerződ[eé]s|munk[aá]ltat[oó]|munkav[aá]llal[oó]|fizet[eé]s|felmond[aá]s)(?!\p{L})', 'iu', 'HR/Employee data', min_count=2),
    Rule('global', 'registry-icd10-code', 'ICD-10 Diagnosis Code', 'pii', 'high', r'\b[A-Z]\d{2}\.\d{1,2}\b', '', 'ICD-10 diagnosis code', min_count=1, count_text='{count} ICD-10 codes'),
    Rule('global', 'global-org-roster', 'Organizational Roster', 'pii', 'medium', r'\b((?:job|future)\s+title|department|team\s+(?:lead|member|name)|(?:site|location)\s+name|line\s+manager|reporting\s+to|headcount|\bfte\b|employee\s+(?:list|roster|directory)|staff\s+list|org(?:anization(?:al)?|anisation)?\s+(?:chart|structure|unit)|befattning|avdelning|arbetsplats|afdeling|medarbejder(?:liste|oversigt)|personaleoversigt)\b', 'i', 'Organizational roster or people list detected', min_count=2, count_text='{count} organizational roster indicators'),
    Rule('global', 'global-financial-report', 'Financial Report', 'financial', 'high', r'(?<!\p{L})(balance\s+sheet|profit\s+and\s+loss|p&l|gross\s+margin|net\s+margin|ebitda|cost\s+of\s+goods\s+sold|operating\s+expenses?|revenue|profitability|supplier\s+costs?|budget)(?!\p{L})', 'iu', 'Financial report content detected', min_count=2),
    Rule('global', 'registry-medical-content', 'Medical Content', 'pii', 'high', r'(?<!\p{L})(patient\s*journal|patientjournal|medical\s*record|health\s*record|clinical\s*note|lab\s*result|blood\s*test|prescription|medication|prognosis|anamnese|epikrise|journal\s*nr|journalnummer|labsvar|laboratoriesvar|laboratorieresultat|blodprøve|laboratorium|sundhedsdata|helbredsoplysninger|patientdata|undersøgelse|prøvesvar|behandling|patientenakte|krankenakte|befund|arztbrief|laborergebnis|blutbild|rezept|medikament|dossier\s+m[eé]dical|ordonnance|r[eé]sultat\s+de\s+laboratoire|ant[eé]c[eé]dents\s+m[eé]dicaux|cartella\s+clinica|referto|ricetta\s+medica|risultato\s+di\s+laboratorio|pati[eë]ntendossier|medisch\s+dossier|laboratoriumresultaat|bloedonderzoek)(?!\p{L})', 'iu', 'Medical content detected', min_count=2),
    Rule('global', 'global-insurance-terms', 'Insurance Document', 'financial', 'medium', r'\b(insurance\s+(?:certificate|policy|company|coverage|claim|premium)|(?:travel|health|life|car|home|motor)\s+insurance|policyholder|insured\s+(?:person|party)|underwriter|forsikring(?:spolice|stager|sselskab)?|bilforsikring|rejseforsikring|livsforsikring|indboforsikring|ulykkesforsikring|ansvarsforsikring|selvrisiko|dæknings?oversigt|forsikringsdækning|policenummer|p[oó]liza(?:\s+de\s+seguro)?|asegurado|aseguradora|cobertura|prima\s+de\s+seguro|siniestro|condiciones\s+generales|seguro\s+(?:de\s+)?(?:vida|auto|hogar|salud|viaje))\b', 'i', 'Insurance document detected', min_count=2, count_text='{count} insurance terms'),
    Rule('global', 'global-dob', 'Date of Birth', 'pii', 'high', r'(?<!\p{L})(?:date\s+of\s+birth|dob|birth\s*date|fødselsdato|födelsedatum|geboortedatum|geburtsdatum)\s*[:\-]?\s*(?:\d{1,2}\s*[\-\/\.,]\s*\d{1,2}\s*[\-\/\.,]\s*\d{2,4}|\d{1,2}(?:st|nd|rd|th)?\s+(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?,?\s+\d{2,4}|(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{2,4})(?!\p{N})', 'iu', 'Date of birth'),
    Rule('global', 'global-insurance-policy-number', 'Insurance Policy Number', 'financial', 'medium', r'\b(?:policy\s*(?:number|no\.?|nr\.?)|policenr\.?|policenummer|police\s*nr\.?)\s*[:\s]\s*\d{5,12}\b', 'i', 'Insurance policy number'),
    Rule('global', 'global-iban', 'IBAN', 'financial', 'high', r'\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b', '', 'Banking information'),
    Rule('global', 'global-swift', 'SWIFT/BIC Code', 'financial', 'medium', r'\b[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\b', '', 'SWIFT/BIC code'),
    Rule('english', 'english-phone-us-formatted', 'Phone Number (US Formatted)', 'pii', 'low', r'\b(?:\(\d{3}\)\s?[-.]?\d{3}[-.]?\d{4}|\d{3}[-.]?\d{3}[-.]?\d{4})\b', '', 'Phone numbers', min_count=5, count_text='{count} phone numbers', cap='medium'),
    Rule('english', 'english-phone-intl-prefix', 'Phone Number (International)', 'pii', 'low', r'\+1[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', '', 'Phone numbers', min_count=2, count_text='{count} phone numbers', cap='medium'),
    Rule('english', 'english-phone-uk-format', 'Phone Number (UK Format)', 'pii', 'low', r'\b(?:\+44[-.\s]?\d{2,4}[-.\s]?\d{3}[-.\s]?\d{4}|0\d{2,4}[-.\s]\d{3}[-.\s]\d{4})\b', '', 'Phone numbers', min_count=3, count_text='{count} phone numbers', cap='medium'),
    Rule('english', 'english-legal-contract', 'Legal Contract Language', 'legal', 'medium', r'\b(whereas|hereby|indemnify|liability|jurisdiction|arbitration|governing\s+law|force\s+majeure)\b', 'i', 'Legal language detected'),
    Rule('english', 'english-legal-nda', 'Non-Disclosure Agreement', 'legal', 'high', r'\b(non-?disclosure|confidentiality\s+agreement|nda|proprietary\s+information\s+agreement)\b', 'i', 'NDA/Legal agreement'),
    Rule('english', 'english-legal-ip', 'Intellectual Property', 'ip', 'high', r'\b(intellectual\s+property|trade\s+secret|patent\s+pending|copyright\s+\d{4}|all\s+rights\s+reserved)\b', 'i', 'IP content detected'),
    Rule('english', 'english-hr-compensation', 'Compensation Data', 'pii', 'high', r'\b(salary|compensation|annual\s+pay|hourly\s+rate|bonus|commission|stock\s+options|equity\s+grant)\b', 'i', 'HR/Employee data', min_count=2),
    Rule('english', 'english-hr-performance', 'Performance Review', 'pii', 'high', r'\b(performance\s+review|annual\s+review|performance\s+rating|disciplinary|termination|severance)\b', 'i', 'HR/Employee data', min_count=2),
    Rule('english', 'english-financial-statement', 'Financial Statement', 'financial', 'medium', r'\b(balance\s+sheet|income\s+statement|cash\s+flow|profit\s+and\s+loss|p&l|fiscal\s+year|quarterly\s+report)\b', 'i', 'Financial document'),
    Rule('english', 'english-financial-banking', 'Banking Details', 'financial', 'high', r'\b(routing\s+number|account\s+number|wire\s+transfer|ach\s+transfer|direct\s+deposit)\b', 'i', 'Banking information'),
    Rule('english', 'english-health-phi', 'Protected Health Information', 'pii', 'critical', r'\b(medical\s+record|patient\s+id|treatment\s+plan|prescription|health\s+insurance|hipaa)\b', 'i', 'Health information', floor=True),
    Rule('english', 'english-gov-clearance', 'Security Clearance', 'confidential', 'critical', r'\b(top\s+secret|secret\s+clearance|classified|for\s+official\s+use\s+only|fouo|sensitive\s+compartmented)\b', 'i', 'Government classification', floor=True),
    Rule('nordic', 'nordic-phone-dk-intl', 'Phone Number (Denmark +45)', 'pii', 'low', r'\+45[-.\s]?\d{2}[-.\s]?\d{2}[-.\s]?\d{2}[-.\s]?\d{2}\b', '', 'Phone numbers', min_count=2, count_text='{count} phone numbers', cap='medium'),
    Rule('nordic', 'nordic-phone-se-intl', 'Phone Number (Sweden +46)', 'pii', 'low', r'\+46[-.\s]?\d{1,3}[-.\s]?\d{2,3}[-.\s]?\d{2}[-.\s]?\d{2}\b', '', 'Phone numbers', min_count=2, count_text='{count} phone numbers', cap='medium'),
    Rule('nordic', 'nordic-phone-no-intl', 'Phone Number (Norway +47)', 'pii', 'low', r'\+47[-.\s]?\d{2}[-.\s]?\d{2}[-.\s]?\d{2}[-.\s]?\d{2}\b', '', 'Phone numbers', min_count=2, count_text='{count} phone numbers', cap='medium'),
    Rule('nordic', 'nordic-phone-fi-intl', 'Phone Number (Finland +358)', 'pii', 'low', r'\+358[-.\s]?\d{1,3}[-.\s]?\d{3}[-.\s]?\d{4}\b', '', 'Phone numbers', min_count=2, count_text='{count} phone numbers', cap='medium'),
    Rule('nordic', 'nordic-phone-labeled', 'Phone Number (Labeled)', 'pii', 'low', r'\b(?:tlf|tel|telefon|mobil|ring)[\s.:]+\d{2}[-.\s]?\d{2}[-.\s]?\d{2}[-.\s]?\d{2}\b', 'i', 'Phone numbers', min_count=1, count_text='{count} phone numbers', cap='medium'),
    Rule('nordic', 'nordic-legal-contract', 'Legal Contract Language (Nordic)', 'legal', 'medium', r'(?<!\p{L})(kontrakt|aftale|avtale|avtal|ansvar|erstatning|forpligtelse|vilkår|betingelser)(?!\p{L})', 'iu', 'Legal language detected'),
    Rule('nordic', 'nordic-confidential', 'Confidentiality Terms (Nordic)', 'confidential', 'high', r'(?<!\p{L})(fortrolig|hemmelig|intern\s+brug|strengt\s+fortroligt|ikke\s+til\s+offentliggørelse)(?!\p{L})', 'iu', 'Confidentiality marker', floor=True),
    Rule('nordic', 'nordic-hr-terms', 'HR Terms (Nordic)', 'pii', 'high', r'(?<!\p{L})(løn|ansættelse|opsigelse|ferie|medarbejder|personale|arbejdsgiver|ansat)(?!\p{L})', 'iu', 'HR/Employee data'),
    Rule('nordic', 'nordic-payroll-terms', 'Payroll Terms (Nordic)', 'pii', 'critical', r'(?<!\p{L})(lönespecifikation|lönspec|månadslön|månlön|bruttolön|nettolön|skatteavdrag|a-skatt|ack\.?\s*skatt|lönnslipp|lønnslipp|månedslønn|bruttolønn|nettolønn|skattetrekk|lønseddel|månedsløn|bruttoløn|nettoløn|löneavdrag|skatteafsnit|arbetsgivaravgift|pensionsinbetalning)(?!\p{L})', 'iu', 'Payroll/Salary data', floor=True),
    Rule('nordic', 'nordic-financial-terms', 'Financial Terms (Nordic)', 'financial', 'medium', r'(?<!\p{L})(regnskab|årsrapport|resultatopgørelse|omsætning|driftsresultat)(?!\p{L})', 'iu', 'Financial document'),
    Rule('romance', 'romance-phone-eu-intl', 'Phone Number (EU Romance)', 'pii', 'low', r'\+(?:33|34|39|351)[-.\s]?\d{1,3}[-.\s]?\d{2,3}[-.\s]?\d{2,3}[-.\s]?\d{2,3}\b', '', 'Phone numbers', min_count=3, count_text='{count} phone numbers', cap='medium'),
    Rule('romance', 'romance-legal-contract', 'Legal Contract Language (Romance)', 'legal', 'medium', r'(?<!\p{L})(contrato|acuerdo|contrat|contratto|cláusula|clause|responsabilidad|responsabilité)(?!\p{L})', 'iu', 'Legal language detected'),
    Rule('romance', 'romance-confidential', 'Confidentiality Terms (Romance)', 'confidential', 'high', r'(?<!\p{L})(confidencial|confidentiel|confidenziale|riservato|réservé|secreto|segreto)(?!\p{L})', 'iu', 'Confidentiality marker', floor=True),
]
