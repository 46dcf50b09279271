"""Words whose nearness makes an identifier credible, or points to something else."""

from __future__ import annotations

# Anchor words of each identifier, in the order they are looked for.
ANCHORS: dict[str, list[str]] = {
    'nordic': ['CPR', 'Personnummer', 'Samordningsnummer', 'HETU', 'IBAN', 'Steuer-ID', 'kontonummer', 'fødselsnummer', 'fodselsnummer', 'Account', 'personnr', 'cpr-nr', 'cprnr', 'fnr'],
    'dk_cpr': ['CPR', 'cpr-nr', 'cprnr', 'personnummer', 'personnr', 'borger', 'patient', 'identifikation', 'fødselsdato', 'national id'],
    'se_personnummer': ['Personnummer', 'personnr', 'Samordningsnummer', 'samordning', 'folkbokföring', 'skatteverket', 'patient', 'id-nummer'],
    'no_fnr': ['fødselsnummer', 'fodselsnummer', 'Personnummer', 'fnr', 'folkeregister', 'patient', 'id-nummer'],
    'fi_hetu': ['HETU', 'henkilötunnus', 'hetu', 'sosiaaliturvatunnus', 'sotu', 'potilasnumero', 'patient'],
    'iban': ['IBAN', 'Account', 'kontonummer', 'kontonr', 'tilinumero', 'bank account', 'banking', 'wire transfer'],
    'de_steuer_id': ['Steuer-ID', 'Steuerid', 'Steueridentifikationsnummer', 'Identifikationsnummer', 'IdNr', 'Finanzamt', 'Steuernummer', 'Steuerpflichtig', 'Einkommensteuer', 'ELSTER', 'Bundeszentralamt'],
    'es_dni_nie': ['dni', 'nie', 'nif', 'cif', 'documento nacional', 'número de identidad', 'identidad', 'identidad personal', 'documento de identidad'],
    'it_codice_fiscale': ['codice fiscale', 'codice fiscale:', 'c.f.', 'cf.', 'codice tributario', 'agenzia delle entrate', 'contribuente', 'partita iva'],
    'pl_pesel': ['pesel', 'numer ewidencyjny', 'identyfikator', 'numer pesel', 'ewidencja ludności'],
    'nl_bsn': ['bsn', 'burgerservicenummer', 'burger service nummer', 'sofinummer', 'sofi-nummer', 'digid', 'belastingdienst', 'gemeente', 'persoonsgegevens'],
    'fr_nir': ['nir', 'insee', 'numéro de sécurité sociale', 'sécurité sociale', 'numero de securite sociale', 'carte vitale', 'vitale', 'cpam', "caisse d'assurance maladie", "numéro d'inscription"],
    'pt_nif': ['nif', 'número de identificação fiscal', 'numero de identificacao fiscal', 'contribuinte', 'número de contribuinte', 'numero de contribuinte', 'finanças', 'financas', 'autoridade tributária', 'autoridade tributaria'],
    'be_nn': ['rijksregisternummer', 'rijksregister', 'nationaal nummer', 'numéro national', 'numero national', 'registre national', 'identiteitskaart', "carte d'identité", "carte d'identite", 'eid', 'belgisch', 'belge'],
    'br_cpf': ['cpf', 'cadastro de pessoas', 'cadastro de pessoas físicas', 'receita federal', 'contribuinte', 'pessoa física', 'pessoa fisica'],
    'mx_curp': ['curp', 'clave única', 'clave unica', 'registro de población', 'registro de poblacion', 'acta de nacimiento', 'ine', 'credencial de elector'],
    'ie_pps': ['pps', 'ppsn', 'pps number', 'personal public service', 'revenue', 'department of social protection', 'deasp', 'hse', 'public services card'],
    'at_sv_nr': ['sozialversicherungsnummer', 'sozialversicherung', 'sv-nr', 'svnr', 'versicherungsnummer', 'österreich', 'osterreich', 'österreichisch', 'pensionsversicherung'],
    'ro_cnp': ['cnp', 'cod numeric personal', 'carte de identitate', 'buletin de identitate', 'codul numeric', 'anaf', 'romania', 'românesc', 'romanesc'],
    'br_cnpj': ['cnpj', 'cadastro nacional', 'pessoa jurídica', 'pessoa juridica', 'razão social', 'razao social', 'empresa', 'cnpj n°', 'cnpj no', 'inscrição federal', 'inscricao federal'],
    'mx_rfc': ['rfc', 'registro federal de contribuyentes', 'contribuyente', 'sat', 'servicio de administración tributaria', 'servicio de administracion tributaria', 'cédula fiscal', 'cedula fiscal', 'constancia fiscal'],
    'ar_cuil': ['cuil', 'cuit', 'afip', 'contribuyente', 'argentina', 'número de cuil', 'número de cuit', 'nro. cuil', 'nro. cuit', 'identificación tributaria', 'identificacion tributaria', 'anses', 'monotributo', 'afp', 'obra social', 'recibo de sueldo', 'liquidación de sueldo', 'liquidacion de sueldo', 'empleador'],
    'cl_rut': ['rut', 'run', 'sii', 'servicio de impuestos', 'registro civil', 'cédula de identidad', 'cedula de identidad', 'chile', 'chileno', 'chilena', 'afp', 'isapre', 'fonasa', 'previred', 'liquidación de sueldo', 'liquidacion de sueldo', 'empleador', 'contrato de trabajo'],
    'cz_rc': ['rodné číslo', 'rodne cislo', 'rodné', 'r.č.', 'česká republika', 'ceska republika', 'slovenská republika', 'slovensko', 'občanský průkaz', 'občiansky preukaz'],
    'hu_taj': ['taj', 'taj szám', 'taj-szám', 'társadalombiztosítási', 'tarsadalombiztositasi', 'taj azonosító', 'egészségbiztosítás', 'egeszsegbiztositas', 'oep', 'tb azonosító'],
    'hu_ado': ['adóazonosító', 'adoazonositó', 'adóazonosító jel', 'adó-azonosító', 'adószám', 'adoszam', 'nav', 'apeh', 'adóhivatal', 'adohivatal'],
    'uk_nin': ['national insurance', 'ni number', 'nino', 'ni no', 'hmrc', 'national insurance number', 'national insurance no', 'paye', 'p45', 'p60', 'self-assessment'],
    'au_tfn': ['tax file number', 'tfn', 'ato', 'australian taxation office', 'tax file', 'myTax', 'myGov'],
    'au_abn': ['abn', 'australian business number', 'ato', 'asic', 'acn', 'gst', 'business number'],
    'ca_sin': ['social insurance', 'sin', 'social insurance number', "numéro d'assurance sociale", 'nas', 'cra', 'canada revenue', 't4', 'rrsp', 'tfsa', 'employment insurance', 'ei premium', 'cpp'],
    'risky_domain': ['IBAN', 'Payroll', 'Gehalt', 'Løn', 'Beneficiary', 'Lønmodtager', 'Medarbejder', 'Personnummer', 'CPR'],
    'safe_domain': ['SKU', 'AWB', 'Ref', 'Sequence', 'Batch', 'Order', 'Invoice No', 'PO', 'Tracking', 'Shipment', 'Part No', 'Item No', 'Catalog'],
}

# Words of which one must be near for the identifier to count at all.
REQUIRED: dict[str, list[str]] = {
    'mx_rfc': ['rfc', 'registro federal de contribuyentes', 'contribuyente', 'sat', 'servicio de administración tributaria', 'servicio de administracion tributaria', 'cédula fiscal', 'cedula fiscal', 'constancia fiscal', 'constancia de situación'],
    'at_sv_nr': ['sozialversicherungsnummer', 'sozialversicherung', 'sv-nr', 'svnr', 'versicherungsnummer', 'österreich', 'osterreich', 'pensionsversicherung', 'geburtsdatum'],
    'cl_rut': ['rut', 'run', 'sii', 'servicio de impuestos', 'registro civil', 'cédula de identidad', 'cedula de identidad', 'chile', 'chileno', 'chilena'],
    'hu_taj': ['taj', 'taj szám', 'taj-szám', 'társadalombiztosítási', 'tarsadalombiztositasi', 'egészségbiztosítás', 'egeszsegbiztositas', 'oep', 'tb azonosító', 'magyarország'],
    'uk_nin': ['national insurance', 'ni number', 'nino', 'ni no', 'hmrc', 'national insurance number', 'national insurance no', 'paye', 'p45', 'p60'],
    'au_tfn': ['tax file number', 'tfn', 'ato', 'australian taxation office', 'tax file', 'mytax', 'mygov', 'australia'],
    'au_abn': ['abn', 'australian business number', 'ato', 'asic', 'gst', 'australia', 'acn'],
    'ca_sin': ['social insurance', 'sin', 'social insurance number', "numéro d'assurance sociale", 'nas', 'cra', 'canada revenue', 't4', 'canada', 'employment insurance'],
}

# Labels of national identifiers, and words of insurance and invoice documents.
LABELS = ['cpr', 'cpr-nr', 'cpr nr', 'cprnr', 'cpr-nummer', 'personnummer', 'personnr', 'fødselsnummer', 'fodselsnummer', 'personal identification', 'national id', 'national identification', 'id-nummer', 'bsn', 'burgerservicenummer', 'nir', 'insee', 'sécurité sociale', 'securite sociale', 'carte vitale', 'nif', 'contribuinte', 'número de contribuinte', 'identificação fiscal', 'rijksregisternummer', 'numéro national', 'numero national', 'registre national', 'cpf', 'cadastro de pessoas', 'curp', 'clave única', 'clave unica']
INSURANCE = ['forsikringspolice', 'forsikring', 'police nr', 'police', 'præmie', 'selvrisiko']
INVOICE = [
    r'\bfaktura\b',
    r'\binvoice\b',
    r'\brechnung\b',
    r'\bfactura\b',
    r'\bkundenr\b',
    r'\bkundenummer\b',
    r'\bcustomer\s*no\b',
    r'\bbankkonto\b',
    r'\bkontonr\b',
    r'\bbank\s*account\b',
    r'\bordrenr\b',
    r'\bordrenummer\b',
    r'\border\s*no\b',
]
