"""lodestrata: review analytics and corpus preparation as DataFrame plans."""
