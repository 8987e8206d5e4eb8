"""URL pattern groups per task kind: a URL is blocked when it holds every part of one group."""

# Fixed values.
RELEVANCE = [
    ["huggingface.co", "esci"],
    ["huggingface.co", "shopping-queries"],
    ["huggingface.co", "shopping_queries"],
    ["huggingface.co", "amazon-product-search"],
    ["huggingface.co", "splade-ecommerce-multidomain"],
    ["huggingface.co", "nemotron-ecommerce-reranker"],
    ["huggingface.co", "ecommerce-product-search-reranker"],
    ["huggingface.co", "amazon-cup"],
    ["huggingface.co", "amazon-query-product-ranking"],
    ["github", "esci"],
    ["api.github.com", "484050569"],
    ["api.github.com", "587791766"],
    ["github", "kdd-cup-2022-amazon"],
    ["github.io", "amazonkddcup"],
    ["kaggle.com", "esci"],
    ["aicrowd.com", "esci"],
    ["arxiv.org", "2206.06588"],
]

# Fixed values.
DETECTION = [
    ["liamdugan/raid"],
    ["raid-bench"],
    ["raid_bench"],
    ["2405.07940"],
    ["2405-07940"],
    ["2024.acl-long.674"],
    ["huggingface.co", "raid"],
    ["github.com", "raid"],
    ["githubusercontent.com", "raid"],
    ["paperswithcode.com", "raid"],
    ["kaggle.com", "raid"],
    ["semanticscholar.org", "a28474db72957c239127374cfee3c8ed8190defc"],
    ["researchgate.net", "384214327"],
    ["liamdugan.com"],
    ["huggingface.co", "bananamind/bananamind-2-ai-detect"],
    ["huggingface.co", "georgedrayson/modernbert-ai-detection-raid-mage"],
    ["huggingface.co", "jaja-09/authorcheck-model"],
    ["huggingface.co", "mayzhou/e5-small-lora-ai-generated-detector"],
    ["huggingface.co", "shushant/adal_ai_detector"],
    ["huggingface.co", "danielfein/raid-ce-gemma4-e4b"],
    ["huggingface.co", "desklib/ai-text-detector-v1.01"],
    ["huggingface.co", "diwank/ai-detector"],
    ["huggingface.co", "fakespot-ai/roberta-base-ai-text-detection-v1"],
    ["huggingface.co", "jaxmef/e5-small-lora-ai-generated-detector-onnx"],
    ["huggingface.co", "limanup/e5-small"],
    ["huggingface.co", "ogmatrixllm/glyph-v1.1"],
    ["huggingface.co", "onnx-community/modernbert-ai-detection-raid-mage-onnx"],
    ["huggingface.co", "oxidane/tmr-ai-text-detector"],
    ["huggingface.co", "subhashbs36/qwen3-0.6-ai-detector-merged"],
    ["huggingface.co", "zonn-ai/modernbert-ai-detection-raid-mage-onnx"],
    ["liamdugan.github.io", "raid"],
    ["apollodft"],
]

# Fixed values.
EXTRACTION = [
    ["google-research-datasets", "mave"],
    ["mave_positives"],
    ["mave_negatives"],
    ["github", "396910272"],
    ["github", "google-research", "mave"],
    ["github", "wehaveaguru", "mave"],
    ["github", "wangjinwj-collab", "mave"],
    ["github", "mengjielee", "mave"],
    ["github", "coder3344", "mave"],
    ["github", "isabella232", "mave"],
    ["github", "br8km", "mave"],
    ["github", "cemoody", "mave"],
    ["github", "tim08094495757", "mave"],
    ["github", "dungnq271", "mave"],
    ["github", "bellyfat", "mave"],
    ["github", "ammonfife", "mave"],
    ["github", "okangela", "mave"],
    ["github", "apurvsibal", "mave"],
    ["github", "rafasofizada", "mave"],
    ["github", "hwijune", "mave"],
    ["github", "kkamaleshkumar", "mave"],
    ["github", "kiminh", "mave"],
    ["github", "kyriakosdz", "mave"],
    ["github", "qpc-worldwide", "mave"],
    ["github", "wanghaisheng", "mave"],
    ["github", "hunterjiang97", "mave"],
    ["github", "matadorhong", "mave"],
    ["github", "alvations", "mave"],
    ["github", "epgauss", "mave"],
    ["github", "boostwu", "mave"],
    ["github", "vanpersie32", "mave"],
    ["github", "1329737379"],
    ["github", "1123073474"],
    ["github", "1000657147"],
    ["github", "883464856"],
    ["github", "854192139"],
    ["github", "797084052"],
    ["github", "792161011"],
    ["github", "766919809"],
    ["github", "711099742"],
    ["github", "694869819"],
    ["github", "598360783"],
    ["github", "591026588"],
    ["github", "583605005"],
    ["github", "581999021"],
    ["github", "565679681"],
    ["github", "506132374"],
    ["github", "504044044"],
    ["github", "502446752"],
    ["github", "485090438"],
    ["github", "481403533"],
    ["github", "477745777"],
    ["github", "474210803"],
    ["github", "470111603"],
    ["github", "467671111"],
    ["github", "449610388"],
    ["github", "449174476"],
    ["av-generation", "mave-dataset"],
    ["pie_chatgpt"],
    ["github", "654679281"],
    ["ninglab", "ecinstruct"],
    ["evelyn5151", "ecinstruct"],
    ["ecellm"],
    ["github", "755203018"],
    ["qwen3.5-4b-ec-magento"],
    ["ministral3-3b-ec-magento"],
    ["phi4-3b-ec-magento"],
    ["gemma4-e2b-ec-magento"],
    ["granite4-3b-ec-magento"],
    ["implicitave"],
    ["github", "753308500"],
    ["parambharat", "av_extraction"],
    ["github", "okangela", "av_extraction"],
    ["github", "564589228"],
    ["wandb.ai", "parambharat", "mave"],
    ["2112.08663"],
    ["2112-08663"],
    ["3488560.3498377"],
    ["mave", "product", "attribute"],
    ["6172422f0c4f244d82c5767c11191a5df46a1715"],
    ["2402.08831"],
    ["lwri4upg2x"],
    ["2404.15592"],
    ["2024.findings-acl.20"],
]
