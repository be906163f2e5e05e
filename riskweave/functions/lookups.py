"""Fixed lookup values for the cleaning operators.

These must equal the reference data for equal results, so they are
stated as plain text, in their natural order. No logic lives here.
"""

from __future__ import annotations

# CNAE-2009 two-digit division -> sector name.
CNAE_SECTORS = {
    '01': 'Agricultura',
    '02': 'Silvicultura',
    '03': 'Pesca',
    '05': 'Mineria_carbon',
    '06': 'Extraccion_petroleo',
    '07': 'Mineria_metalica',
    '08': 'Otras_extractivas',
    '09': 'Servicios_mineria',
    '10': 'Alimentacion',
    '11': 'Bebidas',
    '12': 'Tabaco',
    '13': 'Textil',
    '14': 'Confeccion',
    '15': 'Cuero_calzado',
    '16': 'Madera',
    '17': 'Papel',
    '18': 'Artes_graficas',
    '19': 'Coquerias_refino',
    '20': 'Quimica',
    '21': 'Farmaceutica',
    '22': 'Caucho_plasticos',
    '23': 'Productos_minerales',
    '24': 'Metalurgia',
    '25': 'Productos_metalicos',
    '26': 'Electronica',
    '27': 'Material_electrico',
    '28': 'Maquinaria',
    '29': 'Vehiculos',
    '30': 'Otro_transporte',
    '31': 'Muebles',
    '32': 'Otras_manufacturas',
    '33': 'Reparacion_maquinaria',
    '35': 'Energia_electrica',
    '36': 'Agua',
    '37': 'Saneamiento',
    '38': 'Gestion_residuos',
    '39': 'Descontaminacion',
    '41': 'Construccion_edificios',
    '42': 'Ingenieria_civil',
    '43': 'Actividades_construccion',
    '45': 'Venta_vehiculos',
    '46': 'Comercio_mayorista',
    '47': 'Comercio_minorista',
    '49': 'Transporte_terrestre',
    '50': 'Transporte_maritimo',
    '51': 'Transporte_aereo',
    '52': 'Almacenamiento',
    '53': 'Actividades_postales',
    '55': 'Alojamiento',
    '56': 'Hosteleria',
    '58': 'Edicion',
    '59': 'Cine_video',
    '60': 'Radio_television',
    '61': 'Telecomunicaciones',
    '62': 'Programacion_informatica',
    '63': 'Servicios_informacion',
    '64': 'Servicios_financieros',
    '65': 'Seguros',
    '66': 'Auxiliares_financieros',
    '68': 'Inmobiliarias',
    '69': 'Juridicas_contables',
    '70': 'Sedes_centrales',
    '71': 'Servicios_tecnicos',
    '72': 'Investigacion',
    '73': 'Publicidad',
    '74': 'Otras_profesionales',
    '75': 'Veterinarias',
    '77': 'Alquiler',
    '78': 'Empleo',
    '79': 'Agencias_viajes',
    '80': 'Seguridad',
    '81': 'Servicios_edificios',
    '82': 'Actividades_administrativas',
    '84': 'Administracion_publica',
    '85': 'Educacion',
    '86': 'Sanitarias',
    '87': 'Asistencia_residencial',
    '88': 'Servicios_sociales',
    '90': 'Creacion_artistico',
    '91': 'Bibliotecas_museos',
    '92': 'Juegos_azar',
    '93': 'Deportivas',
    '94': 'Asociativas',
    '95': 'Reparacion_ordenadores',
    '96': 'Otros_servicios_personales',
    '97': 'Hogares_empleados',
    '99': 'Organizaciones_extraterritoriales',
}

# Upper-cased province spelling -> normalised province.
PROVINCE_MAP = {
    'ALAVA': 'Álava',
    'ÁLAVA': 'Álava',
    'ALBACETE': 'Albacete',
    'ALICANTE': 'Alicante',
    'ALICANTE/ALACANT': 'Alicante',
    'ALACANT': 'Alicante',
    'ALMERIA': 'Almería',
    'ALMERÍA': 'Almería',
    'ASTURIAS': 'Asturias',
    'AVILA': 'Ávila',
    'ÁVILA': 'Ávila',
    'BADAJOZ': 'Badajoz',
    'BALEARES': 'Baleares',
    'BARCELONA': 'Barcelona',
    'BIZKAIA': 'Vizcaya',
    'BURGOS': 'Burgos',
    'CACERES': 'Cáceres',
    'CÁCERES': 'Cáceres',
    'CADIZ': 'Cádiz',
    'CÁDIZ': 'Cádiz',
    'CANTABRIA': 'Cantabria',
    'CASTELLON': 'Castellón',
    'CASTELLÓN': 'Castellón',
    'CIUDAD REAL': 'Ciudad Real',
    'CORDOBA': 'Córdoba',
    'CÓRDOBA': 'Córdoba',
    'A CORUÑA': 'A Coruña',
    'LA CORUÑA': 'A Coruña',
    'CORUÑA': 'A Coruña',
    'CORUÑA, A': 'A Coruña',
    'CUENCA': 'Cuenca',
    'GIRONA': 'Gerona',
    'GIRONA (GERONA)': 'Gerona',
    'GERONA': 'Gerona',
    'GRANADA': 'Granada',
    'GUADALAJARA': 'Guadalajara',
    'GIPUZKOA': 'Guipúzcoa',
    'GUIPUZCOA': 'Guipúzcoa',
    'GUIPÚZCOA': 'Guipúzcoa',
    'HUELVA': 'Huelva',
    'HUESCA': 'Huesca',
    'JAEN': 'Jaén',
    'JAÉN': 'Jaén',
    'LEON': 'León',
    'LEÓN': 'León',
    'LLEIDA': 'Lérida',
    'LERIDA': 'Lérida',
    'LÉRIDA': 'Lérida',
    'LA RIOJA': 'La Rioja',
    'LUGO': 'Lugo',
    'MADRID': 'Madrid',
    'MALAGA': 'Málaga',
    'MÁLAGA': 'Málaga',
    'MURCIA': 'Murcia',
    'NAVARRA': 'Navarra',
    'OURENSE': 'Ourense',
    'OURENSE (ORENSE)': 'Ourense',
    'ORENSE': 'Ourense',
    'PALENCIA': 'Palencia',
    'LAS PALMAS': 'Las Palmas',
    'PALMAS DE GRAN CANARIA, LAS': 'Las Palmas',
    'PALMAS, LAS': 'Las Palmas',
    'PONTEVEDRA': 'Pontevedra',
    'SALAMANCA': 'Salamanca',
    'SANTA CRUZ DE TENERIFE': 'Santa Cruz de Tenerife',
    'SEGOVIA': 'Segovia',
    'SEVILLA': 'Sevilla',
    'SORIA': 'Soria',
    'TARRAGONA': 'Tarragona',
    'TERUEL': 'Teruel',
    'TOLEDO': 'Toledo',
    'VALENCIA': 'Valencia',
    'VALLADOLID': 'Valladolid',
    'ZAMORA': 'Zamora',
    'ZARAGOZA': 'Zaragoza',
    'CEUTA': 'Ceuta',
    'MELILLA': 'Melilla',
    'STA. CRUZ TENERIFE': 'Santa Cruz de Tenerife',
    'STA CRUZ DE TENERIFE': 'Santa Cruz de Tenerife',
    'TENERIFE': 'Santa Cruz de Tenerife',
    'S.C. TENERIFE': 'Santa Cruz de Tenerife',
    'SANTA CRUZ TENERIFE': 'Santa Cruz de Tenerife',
    'S.C. DE TENERIFE': 'Santa Cruz de Tenerife',
    'FUERTEVENTURA': 'Las Palmas',
    'LAS PALMAS DE GRAN CANARIA': 'Las Palmas',
    'SAN SEBASTIAN': 'Guipúzcoa',
    'DONOSTIA': 'Guipúzcoa',
    'P. ASTURIAS': 'Asturias',
    'PRINCIPADO DE ASTURIAS': 'Asturias',
    'VIZCAYA': 'Vizcaya',
    'VIZCAIA': 'Vizcaya',
    'AVEIRO': 'Aveiro',
    'BEJA': 'Beja',
    'BRAGA': 'Braga',
    'BRAGANÇA': 'Bragança',
    'BRAGANCA': 'Bragança',
    'CASTELO BRANCO': 'Castelo Branco',
    'COIMBRA': 'Coimbra',
    'ÉVORA': 'Évora',
    'EVORA': 'Évora',
    'FARO': 'Faro',
    'GUARDA': 'Guarda',
    'LEIRIA': 'Leiria',
    'LISBOA': 'Lisboa',
    'PORTALEGRE': 'Portalegre',
    'PORTO': 'Porto',
    'SANTARÉM': 'Santarém',
    'SANTAREM': 'Santarém',
    'SETÚBAL': 'Setúbal',
    'SETUBAL': 'Setúbal',
    'VIANA DO CASTELO': 'Viana do Castelo',
    'VILA REAL': 'Vila Real',
    'VISEU': 'Viseu',
}

# Spellings that are not provinces (set to null before mapping).
INVALID_PROVINCES = [
    'GERMANY',
    'SWITZERLAND',
    'SINGAPUR',
    'SINGAPORE',
    'LONDON',
    'LONDRES',
    'LONDON-UNITED KINGDOM',
    'AMSTERDAM',
    'GINEBRA',
    'GINEGRA',
    'LUGANO',
    'TESINO',
    'BAAR',
    'BADEN -SUIZA',
    'BUCELAS',
    'PAU CEDEX',
    'BE10',
    'CH033',
    'PL91',
    'JUAN DE MARIANA 17 B',
    'FUERTEVENTURA',
    'LAS PALMAS DE GRAN CANARIA',
    'SAN SEBASTIAN',
    'SANTA CRUZ TENERIFE',
    'S.C. DE TENERIFE',
]

# Portuguese districts and places (country corrected to PRT).
PORTUGUESE_PROVINCES = [
    'AVEIRO',
    'BEJA',
    'BRAGA',
    'BRAGANÇA',
    'BRAGANCA',
    'BRAGAN?A',
    'CASTELO BRANCO',
    'COIMBRA',
    'ÉVORA',
    'EVORA',
    'FARO',
    'GUARDA',
    'LEIRIA',
    'LISBOA',
    'LISBON',
    'PORTALEGRE',
    'PORTO',
    'OPORTO',
    'SANTARÉM',
    'SANTAREM',
    'SETÚBAL',
    'SETUBAL',
    'VIANA DO CASTELO',
    'VILA REAL',
    'VISEU',
    'AÇORES',
    'ACORES',
    'AZORES',
    'MADEIRA',
    'VILA DO CONDE',
    'MATOSINHOS',
    'GONDOMAR',
    'MAIA',
    'PÓVOA DE VARZIM',
    'VALONGO',
    'PAREDES',
    'PENAFIEL',
    'SANTO TIRSO',
    'TROFA',
    'AMARANTE',
    'FELGUEIRAS',
    'LOUSADA',
    'PACOS DE FERREIRA',
    'PAÇOS DE FERREIRA',
    'MARCO DE CANAVESES',
    'PÓVOA DO VARZIM',
    'PÓVOA DE VARZIM',
]
