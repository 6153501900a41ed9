"""Part of explainkit."""
