"""Bulletin and prompt texts, and filling their placeholders with columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template as a string column; each ``{name}`` is replaced by ``values[name]``."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


# --- Fixed values: bulletin text ---------------------------------------------------------

RULE = "═══════════════════════════════════════════════════════════════"

BULLETIN = f"""
BOLETÍN DE PELIGRO DE AVALANCHAS
{{zone_upper}}

Fecha de emisión: {{issue_date}}
Válido para: {{valid_from}} a {{valid_to}}

{RULE}

1. RESUMEN EJECUTIVO

El nivel de peligro de avalanchas para {{zone}} es {{level}} - {{label_upper}}.
{{situation}}

{RULE}

2. NIVEL DE PELIGRO (Escala EAWS)

Nivel general: {{level}} - {{label}}
Color: {{color}}

Distribución por elevación:
{{band_lines}}
{RULE}

3. DESCRIPCIÓN DEL PELIGRO

Problemas de avalanchas identificados:
{{problem_lines}}

Ubicaciones afectadas:
  • Elevaciones: {{elevations}}
  • Orientaciones: Todas las orientaciones (especialmente sotavento con viento)
  • Pendientes: 30-45 grados principalmente

{RULE}

4. MANTO NIVOSO

Factores identificados:
{{factor_lines}}
{RULE}

5. PRONÓSTICO METEOROLÓGICO

Se prevén las siguientes condiciones:
  • Nevadas: {{snow}}
  • Viento: {{wind}}
  • Temperatura: {{temperature}}

{RULE}

6. RECOMENDACIONES

Nivel {{level}} - {{label}}:
{{advice}}
Zonas a evitar:
  • {{avoid}}

{RULE}

Este boletín ha sido generado automáticamente. Para más información
contactar a las autoridades locales de seguridad en montaña.

Próxima actualización: {{valid_from}}
"""

ADVICE = {
    1: """
  • Condiciones generalmente favorables
  • Mantener precauciones estándar
  • Evaluar pendientes individuales antes de exponerse
""",
    2: """
  • Condiciones mayormente favorables
  • Precaución en pendientes específicas
  • Evitar pendientes muy empinadas en zonas identificadas
""",
    3: """
  • Condiciones CRÍTICAS - Experiencia requerida
  • Evaluación cuidadosa del terreno ESENCIAL
  • Evitar pendientes empinadas en zonas de riesgo
  • Considerar postergar actividades en elevaciones críticas
""",
    4: """
  • Condiciones MUY CRÍTICAS - Solo expertos
  • Restricción a terreno simple SOLAMENTE
  • Evitar pendientes empinadas
  • Alejarse de zonas de salida de avalanchas
  • Considerar seriamente postergar actividades
""",
    5: """
  • CONDICIONES EXTRAORDINARIAS - PELIGRO EXTREMO
  • EVITAR TODO TERRENO DE AVALANCHAS
  • POSTERGAR ACTIVIDADES
  • Permanecer en zonas seguras solamente
""",
}

SNOW_PROBLEM = "- Nieve reciente: Acumulación de nieve nueva que puede deslizarse"
WIND_PROBLEM = "- Nieve venteada: Formación de placas de viento en orientaciones de sotavento"
WET_PROBLEM = "- Nieve húmeda: Debilitamiento del manto nivoso por temperaturas elevadas"
TERRAIN_PROBLEM = "- Terreno crítico: Presencia de pendientes susceptibles (30-45°)"
NO_PROBLEM = "- Condiciones estables en general"

# --- Fixed values: prompt text -----------------------------------------------------------

PROMPT = """
Eres un experto en predicción de avalanchas. Genera un boletín oficial de peligro de avalanchas siguiendo el formato EAWS (European Avalanche Warning Services).

DATOS DE PREDICCIÓN:
Zona: {zone}
Fecha de emisión: {issue_date}
Válido para: {valid_from} a {valid_to}

PREDICCIONES POR BANDA ALTITUDINAL:
{band_lines}

ESCALA EAWS:
1 - Débil: Nieve generalmente bien estabilizada
2 - Limitado: Nieve moderadamente estabilizada
3 - Notable: Nieve débilmente estabilizada en muchas pendientes
4 - Fuerte: Nieve débilmente estabilizada en mayoría de pendientes
5 - Muy Fuerte: Nieve inestable generalizada

GENERA UN BOLETÍN EN ESPAÑOL CON LA SIGUIENTE ESTRUCTURA (máximo 500 palabras):

1. RESUMEN EJECUTIVO (2-3 frases sobre nivel general y zonas críticas)

2. NIVEL DE PELIGRO
   - Nivel EAWS general
   - Distribución por elevación

3. DESCRIPCIÓN DEL PELIGRO
   - Problemas de avalanchas identificados
   - Ubicaciones y orientaciones afectadas
   - Tamaño y probabilidad de avalanchas

4. MANTO NIVOSO
   - Condiciones actuales
   - Factores desencadenantes

5. PRONÓSTICO METEOROLÓGICO
   - Condiciones esperadas (nevadas, viento, temperatura)

6. RECOMENDACIONES
   - Para montañistas y esquiadores
   - Zonas a evitar
   - Precauciones específicas

IMPORTANTE: Sé preciso, profesional y enfocado en la seguridad. Usa terminología técnica apropiada pero comprensible.
"""
