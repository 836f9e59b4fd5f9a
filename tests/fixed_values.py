"""Fixed values of the worked examples."""

# Keywords of the second harm layer and their categories' weights.
HARM_KEYWORDS = {
    "porn": ("0.8", ["成人视频", "激情裸聊", "色情直播", "在线看片", "福利视频", "一夜情", "约炮", "招嫖", "卖淫", "裸聊", "国产AV", "成人网站", "情色", "黄色视频", "三级片", "色情", "淫秽", "色诱", "裸体", "艳照", "偷拍", "走光", "激情视频", "淫荡", "乱伦", "强奸", "猥亵", "性爱", "自慰", "偷情", "援交", "性工作者"]),
    "gambling": ("0.8", ["真人赌场", "在线赌博", "六合彩", "时时彩", "百家乐", "赌球", "外围投注", "老虎机", "博彩平台", "网上赌场", "澳门赌场", "赌博网站", "体育博彩", "赌场", "博彩", "赌", "棋牌赌博", "扑克赌博", "轮盘赌", "押注", "赌资", "赌马", "百家乐", "龙虎斗", "骰宝", "德州扑克赌博"]),
    "fraud": ("0.7", ["兼职刷单", "日赚", "月入过万", "躺赚", "轻松赚钱", "套现", "代办信用卡", "无抵押贷款", "高利贷", "杀猪盘", "电信诈骗", "中奖信息", "恭喜中奖", "免费领取", "限时领取", "不转不是", "转发到", "刷单", "诈骗", "骗局", "传销", "非法集资", "庞氏骗局", "钓鱼网站", "虚假广告", "假冒", "仿冒", "伪劣", "代开发票", "信用卡套现", "套路贷", "冒充公检法", "洗钱", "黑产", "恶意营销", "诱导消费"]),
    "violence": ("0.8", ["雇凶杀人", "买凶", "杀手", "枪支", "弹药", "砍人", "施暴", "打人视频", "暴力视频", "杀人", "砍人", "枪击", "爆炸", "恐怖袭击", "恐怖分子", "绑架", "勒索", "纵火", "投毒", "斩首", "虐杀", "酷刑", "肢解", "血腥", "凶杀", "碎尸", "屠殺", "暴行", "行凶", "斗殴", "黑帮", "暗杀"]),
    "spam_marketing": ("0.4", ["加微信", "加QQ群", "进群", "免费课程", "限量免费", "名额有限", "手慢无", "速抢", "点击购买", "立即下单", "限时抢购", "优惠券", "满减", "包邮", "秒杀"]),
}

# Negations, and words that strengthen or weaken, with their factors.
NEGATIONS = ["不", "没", "没有", "无", "非", "未", "莫", "勿", "别", "休", "不要", "不会", "不必", "不可", "不用", "不能", "不得", "不许", "不准", "并非", "毫无", "从不", "决不", "毫不", "并未", "尚无", "从未", "岂", "哪", "怎", "难道", "何必"]
INTENSIFIERS = {"极其": "2.5", "极度": "2.5", "万分": "2.5", "非常": "2.0", "特别": "2.0", "尤其": "2.0", "格外": "2.0", "分外": "2.0", "十分": "2.0", "相当": "1.8", "颇": "1.8", "甚": "1.8", "太": "1.8", "真": "1.5", "好": "1.5", "多么": "2.0", "异常": "2.0", "绝对": "1.8", "很": "1.5", "挺": "1.3", "比较": "1.3", "较": "1.3", "更": "1.5", "更加": "1.5", "越来越": "1.8", "越发": "1.5", "愈加": "1.5", "多": "1.3", "这么": "1.3", "那么": "1.3", "如此": "1.5", "蛮": "1.3", "满": "1.3", "够": "1.3", "怪": "1.3", "有点": "0.5", "有些": "0.5", "稍微": "0.3", "略微": "0.3", "稍稍": "0.3", "略": "0.5", "稍": "0.5", "多少": "0.5", "还算": "0.5", "不太": "0.3", "不怎么": "0.3", "不大": "0.3", "略为": "0.4"}
