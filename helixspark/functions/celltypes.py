"""Names of cell types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixspark.functions.text import plain_separators

#: Alias in lower case, with spaces as separators, and the name it stands for.
ALIASES = {
    "nk": "Natural Killer Cell",
    "nk cell": "Natural Killer Cell",
    "natural killer": "Natural Killer Cell",
    "natural killer cell": "Natural Killer Cell",
    "nkt": "Natural Killer T Cell",
    "nkt cell": "Natural Killer T Cell",
    "ilc": "Innate Lymphoid Cell",
    "ilc1": "ILC1",
    "ilc2": "ILC2",
    "ilc3": "ILC3",
    "t cell": "T Cell",
    "tcell": "T Cell",
    "cd4": "CD4+ T Cell",
    "cd4 t": "CD4+ T Cell",
    "cd4 t cell": "CD4+ T Cell",
    "cd4+ t": "CD4+ T Cell",
    "cd4+ t cell": "CD4+ T Cell",
    "cd4t": "CD4+ T Cell",
    "cd4+t": "CD4+ T Cell",
    "th": "CD4+ T Cell",
    "helper t": "CD4+ T Cell",
    "helper t cell": "CD4+ T Cell",
    "cd8": "CD8+ T Cell",
    "cd8 t": "CD8+ T Cell",
    "cd8 t cell": "CD8+ T Cell",
    "cd8+ t": "CD8+ T Cell",
    "cd8+ t cell": "CD8+ T Cell",
    "cd8t": "CD8+ T Cell",
    "cd8+t": "CD8+ T Cell",
    "ctl": "CD8+ T Cell",
    "cytotoxic t": "CD8+ T Cell",
    "cytotoxic t cell": "CD8+ T Cell",
    "treg": "Regulatory T Cell",
    "t reg": "Regulatory T Cell",
    "regulatory t": "Regulatory T Cell",
    "regulatory t cell": "Regulatory T Cell",
    "gdt": "Gamma Delta T Cell",
    "gamma delta t": "Gamma Delta T Cell",
    "gamma delta t cell": "Gamma Delta T Cell",
    "mait": "MAIT Cell",
    "mait cell": "MAIT Cell",
    "b cell": "B Cell",
    "bcell": "B Cell",
    "naive b": "Naive B Cell",
    "naive b cell": "Naive B Cell",
    "memory b": "Memory B Cell",
    "memory b cell": "Memory B Cell",
    "plasma": "Plasma Cell",
    "plasma cell": "Plasma Cell",
    "plasmablast": "Plasmablast",
    "dc": "Dendritic Cell",
    "dendritic cell": "Dendritic Cell",
    "pdc": "Plasmacytoid Dendritic Cell",
    "plasmacytoid dc": "Plasmacytoid Dendritic Cell",
    "plasmacytoid dendritic cell": "Plasmacytoid Dendritic Cell",
    "mdc": "Myeloid Dendritic Cell",
    "myeloid dc": "Myeloid Dendritic Cell",
    "cdc": "Classical Dendritic Cell",
    "classical dc": "Classical Dendritic Cell",
    "cdc1": "Classical Dendritic Cell 1",
    "cdc2": "Classical Dendritic Cell 2",
    "mono": "Monocyte",
    "monocyte": "Monocyte",
    "mo": "Monocyte",
    "classical mono": "Classical Monocyte",
    "classical monocyte": "Classical Monocyte",
    "nonclassical mono": "Non-Classical Monocyte",
    "non classical mono": "Non-Classical Monocyte",
    "nonclassical monocyte": "Non-Classical Monocyte",
    "nc mono": "Non-Classical Monocyte",
    "mac": "Macrophage",
    "macrophage": "Macrophage",
    "kc": "Kupffer Cell",
    "kupffer": "Kupffer Cell",
    "kupffer cell": "Kupffer Cell",
    "neutrophil": "Neutrophil",
    "neu": "Neutrophil",
    "basophil": "Basophil",
    "baso": "Basophil",
    "eosinophil": "Eosinophil",
    "eo": "Eosinophil",
    "mast": "Mast Cell",
    "mast cell": "Mast Cell",
    "rbc": "Erythrocyte",
    "erythrocyte": "Erythrocyte",
    "ery": "Erythrocyte",
    "erythroblast": "Erythroblast",
    "meg": "Megakaryocyte",
    "megakaryocyte": "Megakaryocyte",
    "platelet": "Platelet",
    "hsc": "Hematopoietic Stem Cell",
    "hematopoietic stem cell": "Hematopoietic Stem Cell",
    "mpp": "Multipotent Progenitor",
    "lmpp": "Lymphoid-Primed Multipotent Progenitor",
    "clp": "Common Lymphoid Progenitor",
    "cmp": "Common Myeloid Progenitor",
    "gmp": "Granulocyte-Monocyte Progenitor",
    "ec": "Endothelial Cell",
    "endo": "Endothelial Cell",
    "endothelial": "Endothelial Cell",
    "endothelial cell": "Endothelial Cell",
    "fib": "Fibroblast",
    "fb": "Fibroblast",
    "fibroblast": "Fibroblast",
    "smc": "Smooth Muscle Cell",
    "smooth muscle": "Smooth Muscle Cell",
    "smooth muscle cell": "Smooth Muscle Cell",
    "peri": "Pericyte",
    "pericyte": "Pericyte",
    "neuron": "Neuron",
    "oligo": "Oligodendrocyte",
    "oligodendrocyte": "Oligodendrocyte",
    "opc": "Oligodendrocyte Precursor Cell",
    "astro": "Astrocyte",
    "astrocyte": "Astrocyte",
    "microglia": "Microglia",
    "mg": "Microglia",
    "schwann": "Schwann Cell",
    "schwann cell": "Schwann Cell",
    "epi": "Epithelial Cell",
    "epithelial": "Epithelial Cell",
    "epithelial cell": "Epithelial Cell",
    "goblet": "Goblet Cell",
    "goblet cell": "Goblet Cell",
    "tuft": "Tuft Cell",
    "tuft cell": "Tuft Cell",
    "enterocyte": "Enterocyte",
    "enteroendocrine": "Enteroendocrine Cell",
    "enteroendocrine cell": "Enteroendocrine Cell",
    "ee": "Enteroendocrine Cell",
    "hep": "Hepatocyte",
    "hepatocyte": "Hepatocyte",
    "cholangiocyte": "Cholangiocyte",
    "adipocyte": "Adipocyte",
    "adipo": "Adipocyte",
}


def canonical(x: Column, extra: Mapping[str, str] | None = None) -> Column:
    """The name of a cell type: ``extra`` first, then the table, else the string with plain separators. "", nan, None and NULL stay."""
    table = ALIASES | {k.lower(): v for k, v in (extra or {}).items() if v}
    lookup = F.create_map(*(F.lit(s) for pair in table.items() for s in pair))
    name = plain_separators(x)
    return F.when(x.isNull() | x.isin("", "nan", "None"), x).otherwise(F.coalesce(F.try_element_at(lookup, F.lower(name)), name))
